"""Online filtering and alarms over Structured Streaming, with the kernels of the batch path.

State per series: filtered probabilities, step count, cumulative log score, and the detector's (previous probabilities, baseline,
crossings in a row, cooldown). A micro-batch's rows are sorted by time; rows before the last one seen are late and are
dropped, as a causal filter can't take them. Rows of one instant are steps of their own, as in the batch path, in the order of
their number if they have one, else as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import kernels as K
from ..operators.clean import SERIES

OUT = f"{SERIES} string, t bigint, ts timestamp_ntz, y double, filtered array<double>, log_c double, cumulative double, score double, ready boolean, alarm boolean, dominant int"
SOURCE = f"{SERIES} string, ts timestamp_ntz, n bigint, y double"
COLUMNS = [c.split(" ")[0] for c in OUT.split(", ")]
STATE = "filtered array<double>, t bigint, cumulative double, baseline double, count int, left int, last timestamp_ntz, session date"


class Session:
    """The online filter and a detector, one observation at a time."""

    def __init__(self, p: K.Params, d: K.Detector):
        self.p, self.d = p.check(), d.check()
        self.reset()

    def reset(self) -> None:
        self.filtered, self.t, self.cumulative = self.p.pi, 0, 0.0
        self.baseline, self.count, self.left = None, 0, 0

    def load(self, filtered, t: int, cumulative: float, baseline: float | None, count: int, left: int) -> None:
        self.filtered, self.t, self.cumulative = np.array(filtered, float), t, cumulative
        self.baseline, self.count, self.left = baseline, count, left

    def step(self, y: float) -> dict:
        """Predict, score, update, detect."""
        before = self.filtered
        f = K.forward_filter(K.Params(before, self.p.transition, self.p.means, self.p.variances), np.array([y]), move_first=True)
        now, log_c = f.filtered[0], float(f.log_c[0])
        if abs(now.sum() - 1) > K.SIMPLEX_TOL:
            raise K.ModelError("filtered probabilities don't sum to one")
        self.t += 1
        self.cumulative += log_c
        first, d = self.t == 1, self.d
        if d.kind == "surprise":
            ready, score = d.alpha is None or not first, -log_c
            if d.alpha is not None:
                score = 0.0 if first else -log_c - self.baseline
                self.baseline = -log_c if first else d.alpha * -log_c + (1 - d.alpha) * self.baseline
            crossed = ready and score >= d.threshold
        else:
            ready = not first
            pair = K.Filtered(np.empty(0), np.stack([before, now]), np.array([0.0, log_c]))
            got, cross, _ = K.scores(d, pair.filtered, pair.log_c)
            score, crossed = (float(got[1]), bool(cross[1])) if ready else (0.0, False)
        alarm, self.count, self.left = K.persist([crossed], [ready], d.required, d.cooldown, self.count, self.left)
        self.filtered = now
        return {"t": self.t, "filtered": now.tolist(), "predicted_next": (now @ self.p.transition).tolist(), "log_c": log_c, "cumulative": self.cumulative, "score": score, "ready": bool(ready), "alarm": alarm[0], "dominant": int(K.dominant(now[None])[0])}

    def run(self, ys) -> list[dict]:
        return [self.step(float(y)) for y in ys]

    def steps(self, y: np.ndarray) -> dict:
        """Many steps at once, as arrays."""
        before = self.filtered if self.t else None
        f = K.forward_filter(K.Params(self.filtered, self.p.transition, self.p.means, self.p.variances), y, move_first=True)
        if (np.abs(f.filtered.sum(1) - 1) > K.SIMPLEX_TOL).any():
            raise K.ModelError("filtered probabilities don't sum to one")
        score, crossed, ready, self.baseline = K.resume(self.d, f.filtered, f.log_c, before, self.baseline)
        alarm, self.count, self.left = K.persist(crossed.tolist(), ready.tolist(), self.d.required, self.d.cooldown, self.count, self.left)
        cumulative = np.cumsum(np.append(self.cumulative, f.log_c))[1:]
        t = self.t + np.arange(1, len(y) + 1)
        self.filtered, self.t, self.cumulative = f.filtered[-1], int(t[-1]), float(cumulative[-1])
        return {"t": t, "filtered": list(f.filtered), "log_c": f.log_c, "cumulative": cumulative, "score": score, "ready": ready, "alarm": alarm, "dominant": K.dominant(f.filtered).astype(np.int32)}


#: Rows that a series' steps are taken and given in.
CHUNK = 10_000


class OnlineProcessor(StatefulProcessor):
    def __init__(self, p: K.Params, d: K.Detector, reset_on_session: bool = False):
        self.p, self.d, self.reset_on_session = p, d, reset_on_session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, last, day = Session(self.p, self.d), None, None
        if self.state.exists():
            s = self.state.get()
            session.load(s[0], s[1], s[2], s[3], s[4], s[5])
            last, day = s[6], s[7]
        pdf = pd.concat(list(rows))
        pdf = pdf.sort_values([c for c in ("ts", "n") if c in pdf], kind="stable", ignore_index=True)
        if last is not None:
            pdf = pdf[pdf["ts"] >= pd.Timestamp(last)]
        days = pdf["ts"].dt.date
        for own, part in pdf.groupby(days) if self.reset_on_session else [(None, pdf)]:
            if self.reset_on_session and day is not None and own != day:
                session.reset()
            day = own
            for a in range(0, len(part), CHUNK):
                some = part.iloc[a : a + CHUNK]
                got = session.steps(some["y"].to_numpy(float))
                yield pd.DataFrame({SERIES: key[0], "t": got["t"], "ts": some["ts"].to_numpy(), "y": some["y"].to_numpy(float), **{c: got[c] for c in COLUMNS[4:]}})
        if len(pdf):
            self.state.update((session.filtered.tolist(), session.t, session.cumulative, session.baseline, session.count, session.left, pdf["ts"].iloc[-1].to_pydatetime(), days.iloc[-1]))

    def close(self) -> None:
        pass


def online(stream: DataFrame, p: K.Params, d: K.Detector, reset_on_session: bool = False) -> DataFrame:
    """Steps of a frozen model over a stream (series_id, ts, y, and n, the order of rows of one instant, if there is one). Needs the RocksDB state store provider."""
    return stream.select(SERIES, "ts", "y", *[c for c in ("n",) if c in stream.columns]).groupBy(SERIES).transformWithStateInPandas(OnlineProcessor(p, d, reset_on_session), OUT, "Append", "None")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replay(rows: DataFrame, p: K.Params, d: K.Detector, folder: str, parts: int = 1) -> DataFrame:
    """Rows (series_id, t, ts, y) through the stream to the end, and what it wrote: they are saved in `folder` as the stream's
    source, in the order of time if there are several parts, and read with the trigger availableNow.

    A part is written by series, so that it spreads over tasks: a series has one file in a part, and the files of a part are newer than those of the part before.
    A micro-batch takes about as many files as a part has."""
    spark = rows.sparkSession
    numbered = rows.select(SERIES, "ts", F.col("t").alias("n"), "y")
    x = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = numbered.select(x.cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    numbered = numbered.withColumn("part", sum(((x > c).cast("int") for c in cuts), F.lit(0)))
    for i in range(parts):
        numbered.where(F.col("part") == i).drop("part").repartition(SERIES).write.mode("append").parquet(f"{folder}/in")
    files = max(1, -(-len(spark.read.schema(SOURCE).parquet(f"{folder}/in").inputFiles()) // parts))
    key, value = STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        source = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
        query = online(source, p, d).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(OUT).parquet(f"{folder}/out")
