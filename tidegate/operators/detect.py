"""Alarm detectors over filtered probabilities.

Scores need the row before only, so they are windows; the running baseline and the persistence rule are recursions and go
through the kernels, one series at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import dominant, total_variation
from .clean import SERIES


def with_dominant(posterior: DataFrame) -> DataFrame:
    return posterior.withColumn("dominant", dominant("filtered").cast("int"))


def score_rows(posterior: DataFrame, d: K.Detector) -> DataFrame:
    """(series_id, t, score, crossed, ready) of a detector without baseline, in window functions."""
    d.check()
    if d.alpha is not None:
        raise K.ModelError("a running baseline is a recursion; use alarms()")
    w = Window.partitionBy(SERIES).orderBy("t")
    rows = posterior.select(SERIES, "t", "filtered", "log_c", dominant("filtered").alias("top"))
    rows = rows.withColumns({"before": F.lag("filtered").over(w), "top_before": F.lag("top").over(w)})
    ready = F.col("before").isNotNull()
    if d.kind == "surprise":
        score, ready = -F.col("log_c"), F.lit(True)
    elif d.kind == "hard_switch":
        score = ((F.col("top") != F.col("top_before")) & (F.get("filtered", F.col("top")) >= max(d.threshold, 0.0))).cast("double")
    elif d.kind == "leave_previous":
        score = 1 - F.get("filtered", F.col("top_before"))
    else:
        score = total_variation("filtered", "before")
    crossed = F.col("score") > 0 if d.kind == "hard_switch" else F.col("score") >= d.threshold
    rows = rows.select(SERIES, "t", ready.alias("ready"), F.when(ready, score).otherwise(0.0).alias("score"))
    return rows.select(SERIES, "t", "score", (F.col("ready") & crossed).alias("crossed"), "ready")


ALARMS = f"{SERIES} string, t bigint, ts timestamp_ntz, score double, ready boolean, alarm boolean, dominant int, dominant_before int"


def _steps(pdf: pd.DataFrame, d: K.Detector, f: K.Filtered) -> dict:
    got = K.detect(d, f)
    before = pd.Series([None] * len(pdf) if d.kind == "surprise" else [None, *got["dominant"][:-1].tolist()], dtype="Int32")
    return {SERIES: pdf[SERIES], "t": pdf["t"], "ts": pdf["ts"], "score": got["score"], "ready": got["ready"], "alarm": got["alarm"], "dominant": got["dominant"].astype("int32"), "dominant_before": before}


def online_run(obs: DataFrame, p: K.Params, d: K.Detector) -> DataFrame:
    """A frozen model and a detector over rows (series_id, t, ts, y) in one pass: the columns of alarms(), and y, filtered and log_c."""
    p.check(), d.check()

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        f = K.forward_filter(p, pdf["y"].to_numpy(float), True)
        return pd.DataFrame({**_steps(pdf, d, f), "y": pdf["y"], "filtered": list(f.filtered), "log_c": f.log_c})

    return obs.select(SERIES, "t", "ts", "y").groupBy(SERIES).applyInPandas(body, f"{ALARMS}, y double, filtered array<double>, log_c double")


def alarms(posterior: DataFrame, d: K.Detector) -> DataFrame:
    """Every step of a detector: (series_id, t, ts, score, ready, alarm, dominant, dominant_before); a surprise has no regime before."""
    d.check()

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        return pd.DataFrame(_steps(pdf, d, K.Filtered(np.empty(0), np.array(pdf["filtered"].tolist(), float), pdf["log_c"].to_numpy(float))))

    return posterior.select(SERIES, "t", "ts", "filtered", "log_c").groupBy(SERIES).applyInPandas(body, ALARMS)


FOLDED = f"{SERIES} string, n_alarms bigint, last_alarm bigint"


def persistence(scores: DataFrame, required: int, cooldown: int) -> DataFrame:
    """(series_id, n_alarms, last_alarm) by the persistence rule. Sorted rows go by once; what is held is a batch and the rule's state."""
    rows = scores.select(SERIES, "t", "crossed", "ready").repartition(SERIES).sortWithinPartitions(SERIES, "t")
    names = [c.split(" ")[0] for c in FOLDED.split(", ")]

    def body(batches):
        now, n, last, count, left = None, 0, None, 0, 0

        def done():
            return pd.DataFrame({names[0]: [now], names[1]: [n], names[2]: pd.array([last], dtype="Int64")})

        for pdf in batches:
            s = pdf[SERIES].to_numpy(object)
            cut = (np.flatnonzero(s[1:] != s[:-1]) + 1).tolist()
            for a, b in zip([0, *cut], [*cut, len(s)]):
                if a == b:
                    continue
                if s[a] != now:
                    if now is not None:
                        yield done()
                    now, n, last, count, left = s[a], 0, None, 0, 0
                part = pdf.iloc[a:b]
                alarm, count, left = K.persist(part["crossed"].tolist(), part["ready"].tolist(), required, cooldown, count, left)
                hit = part["t"].to_numpy()[np.array(alarm, bool)]
                n, last = n + len(hit), int(hit[-1]) if len(hit) else last
        if now is not None:
            yield done()

    return rows.mapInPandas(body, FOLDED)
