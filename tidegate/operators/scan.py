"""Recursions over series that are longer than a task should hold, as blocked scans: filter, smoother, a step of EM, alarms.

A block of consecutive rows is summed up by what it does to whatever comes in: the filter and the smoother by the scaled product of
their K x K steps, a running baseline by a line, the persistence rule by the end state of each of its few start states. These
summaries of a series are chained in one row a block; a second pass fills the blocks from what reaches them. Only summaries and, where a row
needs the one before, a block's last row move between the passes. t counts from 1 without holes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import detect
from .clean import SERIES
from .hmm import PARAMS, POSTERIOR


def _steps(p: K.Params, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    logs = K.log_density(y, p.means, p.variances)
    shift = logs.max(1)
    return p.transition[None] * np.exp(logs - shift[:, None])[:, None, :], shift


def blocked_filter(obs: DataFrame, p: K.Params, move_first: bool = True, block_rows: int = 100_000) -> DataFrame:
    """As hmm.filter_rows, for rows (series_id, t from 1 without holes, ts, y), holding block_rows rows at a time.

    A block whose product vanishes (an outlier that the only possible regime can't explain) fails with ModelError, as
    its density does."""
    p.check()
    rows = obs.select(SERIES, "t", "ts", "y").withColumn("block", F.floor((F.col("t") - 1) / block_rows).cast("long"))
    k = p.k

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        steps, _ = _steps(p, pdf["y"].to_numpy(float))
        if pdf["t"].iloc[0] == 1 and not move_first:
            steps[0] = np.diag(steps[0].sum(0) / p.transition.sum(0))
        whole = np.eye(k)
        for s in steps:
            whole = whole @ s
            if not whole.max() > 0:
                raise K.ModelError("the density of a block vanishes")
            whole /= whole.max()
        return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], "block": int(pdf["block"].iloc[0]), "m": whole.ravel()}])

    products = rows.groupBy(SERIES, "block").applyInPandas(product, f"{SERIES} string, block bigint, m array<double>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        v, out = p.pi, []
        for m in pdf["m"]:
            out.append(v)
            v = v @ np.array(m).reshape(k, k)
            if not v.sum() > 0:
                raise K.ModelError("the density of a block vanishes")
            v = v / v.sum()
        return pd.DataFrame({SERIES: pdf[SERIES], "block": pdf["block"], "start": out})

    starts = products.groupBy(SERIES).applyInPandas(chain, f"{SERIES} string, block bigint, start array<double>")

    def fill(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        first = bool(pdf["t"].iloc[0] == 1)
        part = K.Params(np.array(start["start"].iloc[0]), p.transition, p.means, p.variances)
        f = K.forward_filter(part, pdf["y"].to_numpy(float), move_first=move_first or not first)
        return pd.DataFrame({SERIES: pdf[SERIES], "t": pdf["t"], "ts": pdf["ts"], "y": pdf["y"], "predicted": list(f.predicted), "filtered": list(f.filtered), "log_c": f.log_c})

    return rows.groupBy(SERIES, "block").cogroup(starts.groupBy(SERIES, "block")).applyInPandas(fill, POSTERIOR)


def _empty(*names: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})


def _in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    return rows.withColumn("block", F.floor((F.col("t") - 1) / block_rows).cast("long"))


def _back_steps(p: K.Params, filtered: np.ndarray) -> np.ndarray:
    """gamma[t] = step[t] gamma[t+1], up to scale: diag(f[t]) P diag(1 / pred[t+1]), where pred[t+1] = f[t] P."""
    ahead = filtered @ p.transition
    ratio = np.where(ahead < K.RATIO_FLOOR, 0.0, 1.0 / np.maximum(ahead, K.RATIO_FLOOR))
    return filtered[:, :, None] * p.transition[None] * ratio[:, None, :]


def _scaled(v: np.ndarray) -> np.ndarray:
    return v / v.sum() if v.sum() > 0 else v


def _smooth_block(p: K.Params, filtered: np.ndarray, after: np.ndarray | None) -> np.ndarray:
    """Smoothed probabilities of a block; after: those of the first row behind it."""
    steps = _back_steps(p, filtered)
    last = filtered[-1] if after is None else _scaled(steps[-1] @ after)
    got = K._sweep(steps[:-1].transpose(0, 2, 1)[::-1], last) if len(steps) > 1 else (np.zeros((0, p.k)), None)
    if got is not None:
        return np.concatenate((got[0][::-1], last[None]))
    out = np.empty_like(filtered)
    out[-1] = last
    for i in range(len(steps) - 2, -1, -1):
        out[i] = _scaled(steps[i] @ out[i + 1])
    return out


def _after(posterior: DataFrame, p: K.Params, block_rows: int) -> DataFrame:
    """(series_id, block, after): the smoothed probabilities of the first row behind each block; null behind the last one."""
    k = p.k

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        filtered = np.array(pdf.sort_values("t")["filtered"].tolist(), float)
        whole = np.eye(k)
        for step in _back_steps(p, filtered[:-1])[::-1]:
            whole = step @ whole
            whole /= max(whole.max(), K.RATIO_FLOOR)
        return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], "block": int(pdf["block"].iloc[0]), "m": whole.ravel(), "last": filtered[-1]}])

    products = _in_blocks(posterior.select(SERIES, "t", "filtered"), block_rows).groupBy(SERIES, "block").applyInPandas(product, f"{SERIES} string, block bigint, m array<double>, last array<double>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=False, ignore_index=True)
        out, g = [], None
        for m, last in zip(pdf["m"], pdf["last"]):
            out.append(g)
            last = np.array(last)
            g = _scaled(np.array(m).reshape(k, k) @ (last if g is None else _scaled(_back_steps(p, last[None])[0] @ g)))
        return pd.DataFrame({SERIES: pdf[SERIES], "block": pdf["block"], "after": out})

    return products.groupBy(SERIES).applyInPandas(chain, f"{SERIES} string, block bigint, after array<double>")


def _with_after(obs: DataFrame, p: K.Params, block_rows: int, body, out: str) -> DataFrame:
    """body(rows of a block in order, filtered, smoothed, after) for each block."""
    posterior = blocked_filter(obs, p, False, block_rows)

    def fill(pdf: pd.DataFrame, behind: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        filtered = np.array(pdf["filtered"].tolist(), float)
        after = behind["after"].iloc[0]
        after = None if after is None else np.array(after, float)
        return body(pdf, filtered, _smooth_block(p, filtered, after), after)

    return _in_blocks(posterior, block_rows).groupBy(SERIES, "block").cogroup(_after(posterior, p, block_rows).groupBy(SERIES, "block")).applyInPandas(fill, out)


def blocked_smoother(obs: DataFrame, p: K.Params, block_rows: int = 100_000) -> DataFrame:
    """As hmm.smooth_rows, holding block_rows rows at a time."""
    columns = [c.split(" ")[0] for c in POSTERIOR.split(", ")]
    return _with_after(obs, p, block_rows, lambda pdf, f, s, after: pdf[columns].assign(smoothed=list(s)), POSTERIOR + ", smoothed array<double>")


def blocked_em_step(obs: DataFrame, p: K.Params, block_rows: int = 100_000) -> DataFrame:
    """As hmm.em_step: blocks give the sums of the M step (weights, weighted means and squares about them, expected transitions), a row a block."""
    k = p.k
    sums = f"{SERIES} string, block bigint, first array<double>, leave array<double>, weight array<double>, mean array<double>, squares array<double>, expected array<double>, log_c double"

    def body(pdf: pd.DataFrame, filtered: np.ndarray, smoothed: np.ndarray, after: np.ndarray | None) -> pd.DataFrame:
        y = pdf["y"].to_numpy(float)
        weight = smoothed.sum(0)
        mean = smoothed.T @ y / np.maximum(weight, K.RATIO_FLOOR)
        ahead = smoothed[1:] if after is None else np.concatenate((smoothed[1:], after[None]))
        now = filtered[: len(ahead)]
        pred = now @ p.transition
        expected = (now[:, :, None] * p.transition[None] * np.where(pred < K.RATIO_FLOOR, 0.0, ahead / np.maximum(pred, K.RATIO_FLOOR))[:, None, :]).sum(0)
        row = {SERIES: pdf[SERIES].iloc[0], "block": int(pdf["block"].iloc[0]), "first": smoothed[0], "leave": smoothed[: len(ahead)].sum(0), "weight": weight, "mean": mean, "squares": (smoothed * (y[:, None] - mean) ** 2).sum(0), "expected": expected.ravel(), "log_c": float(pdf["log_c"].sum())}
        return pd.DataFrame([row])

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        get = lambda c: np.array(pdf[c].tolist(), float)
        weights, means = get("weight"), get("mean")
        weight, leave = weights.sum(0), get("leave").sum(0)
        has, safe = weight >= K.WEIGHT_FLOOR, np.where(weight >= K.WEIGHT_FLOOR, weight, 1.0)
        mean = np.where(has, (weights * means).sum(0) / safe, p.means)
        spread = (get("squares") + weights * (means - mean) ** 2).sum(0) / safe
        rows = np.where(leave[:, None] < K.WEIGHT_FLOOR, p.transition, get("expected").sum(0).reshape(k, k) / np.maximum(leave, K.WEIGHT_FLOOR)[:, None])
        new = K.Params(_scaled(get("first")[0]), rows / rows.sum(1, keepdims=True), mean, np.where(has, np.maximum(spread, K.VARIANCE_FLOOR), p.variances))
        return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], **new.row(), "log_likelihood": float(pdf["log_c"].sum())}])

    return _with_after(obs, p, block_rows, body, sums).groupBy(SERIES).applyInPandas(update, f"{SERIES} string, {PARAMS}, log_likelihood double")


def blocked_alarms(posterior: DataFrame, d: K.Detector, block_rows: int = 100_000) -> DataFrame:
    """As detect.alarms, for rows (series_id, t from 1 without holes, ts, filtered, log_c), holding block_rows rows at a time.

    The persistence rule has as many states as crossings it waits for and steps it pauses, so a block is told by the end state of each."""
    d.check()
    rows = _in_blocks(posterior.select(SERIES, "t", "ts", "filtered", "log_c"), block_rows).withColumn("ahead", F.lit(False))
    # A score looks one row back: a block's last row also goes to the next block, where it is only looked at.
    rows = rows.unionByName(rows.where(F.col("t") % block_rows == 0).withColumns({"block": F.col("block") + 1, "ahead": F.lit(True)}))
    states = [(c, 0) for c in range(d.required)] + [(0, c) for c in range(1, d.cooldown + 1)]
    running = d.kind == "surprise" and d.alpha is not None
    key = f"{SERIES} string, block bigint"

    def chained(summaries: DataFrame, columns: list[str], start, step, kind: str) -> DataFrame:
        """(series_id, block, start): what reaches each block, from what the blocks before it do."""

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("block", ignore_index=True)
            out, now = [], start
            for values in zip(*(pdf[c] for c in columns)):
                out.append(now)
                now = step(now, *values)
            return pd.DataFrame({SERIES: pdf[SERIES], "block": pdf["block"], "start": out})

        return summaries.groupBy(SERIES).applyInPandas(chain, f"{key}, start {kind}")

    def own(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int]:
        pdf = pdf.sort_values("t", ignore_index=True)
        return pdf, int(pdf["ahead"].sum())

    def scores(pdf: pd.DataFrame, skip: int, base: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        log_c = pdf["log_c"].to_numpy(float)
        if not running:
            got = K.scores(d, np.array(pdf["filtered"].tolist(), float), log_c)
            return tuple(x[skip:] for x in got)
        s = -log_c[skip:]
        first = bool(pdf["t"].iloc[skip] == 1)
        score, ready = np.zeros(len(s)), np.ones(len(s), bool)
        ready[0] = not first
        base = s[0] if first else base
        for i in range(int(first), len(s)):
            score[i] = s[i] - base
            base = d.alpha * s[i] + (1 - d.alpha) * base
        return score, ready & (score >= d.threshold), ready

    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        """What a block makes of the running baseline: slope * baseline + more."""
        pdf, skip = own(pdf)
        s = -pdf["log_c"].to_numpy(float)[skip:]
        if not len(s):
            return _empty(SERIES, "block", "slope", "more")
        slope, more = (0.0, s[0]) if pdf["t"].iloc[skip] == 1 else (1.0, 0.0)
        for x in s[1 if slope == 0 else 0 :]:
            slope, more = (1 - d.alpha) * slope, d.alpha * x + (1 - d.alpha) * more
        return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], "block": int(pdf["block"].iloc[0]), "slope": slope, "more": more}])

    if running:
        lines = rows.groupBy(SERIES, "block").applyInPandas(line, f"{key}, slope double, more double")
        bases = chained(lines, ["slope", "more"], 0.0, lambda now, slope, more: slope * now + more, "double").withColumnRenamed("start", "base")
    else:
        bases = rows.where("NOT ahead").select(F.concat(SERIES, F.lit("")).alias(SERIES), (F.col("block") + 0).alias("block"), F.lit(None).cast("double").alias("base")).distinct()

    def ends(pdf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        pdf, skip = own(pdf)
        if len(pdf) == skip:
            return _empty(SERIES, "block", "ends")
        _, crossed, ready = scores(pdf, skip, more["base"].iloc[0])
        crossed, ready = crossed.tolist(), ready.tolist()
        got = [states.index(K.persist(crossed, ready, d.required, d.cooldown, *x)[1:]) for x in states]
        return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], "block": int(pdf["block"].iloc[0]), "ends": got}])

    by_block = rows.groupBy(SERIES, "block")
    tables = by_block.cogroup(bases.groupBy(SERIES, "block")).applyInPandas(ends, f"{key}, ends array<int>")
    starts = chained(tables, ["ends"], 0, lambda now, to: int(to[now]), "int").join(bases, [SERIES, "block"])

    def fill(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf, skip = own(pdf)
        if len(pdf) == skip:
            return _empty(*(c.split(" ")[0] for c in detect.ALARMS.split(", ")))
        score, crossed, ready = scores(pdf, skip, start["base"].iloc[0])
        alarm = K.persist(crossed.tolist(), ready.tolist(), d.required, d.cooldown, *states[int(start["start"].iloc[0])])[0]
        top = K.dominant(np.array(pdf["filtered"].tolist(), float))
        before = [None] * len(pdf) if d.kind == "surprise" else [None, *top[:-1].tolist()]
        pdf = pdf.iloc[skip:].reset_index(drop=True)
        return pdf[[SERIES, "t", "ts"]].assign(score=score, ready=ready, alarm=alarm, dominant=top[skip:].astype("int32"), dominant_before=pd.Series(before[skip:], dtype="Int32"))

    return by_block.cogroup(starts.groupBy(SERIES, "block")).applyInPandas(fill, detect.ALARMS)
