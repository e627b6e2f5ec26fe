"""Parameter search with shared fits.

Only the number of regimes and the feature family change a fit, so each (series, k, family) is fitted and
filtered once; the detector grid is laid over the filtered rows. They go by once for each chunk of the grid, sorted by time, and
what is held is a batch and the state of the chunk's detectors; a search spreads over series x models x chunks of the grid.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import features as feats
from . import hmm
from .clean import SERIES


@dataclass(frozen=True)
class Grid:
    thresholds: tuple[float, ...] = (0.1, 0.3, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
    required: tuple[int, ...] = (1, 2, 3)
    cooldowns: tuple[int, ...] = (0, 2, 5)

    def points(self) -> list[tuple[float, int, int]]:
        return list(product(self.thresholds, self.required, self.cooldowns))


#: The grids for real series.
REAL_GRIDS = {
    "hard_switch": Grid((0.30, 0.40, 0.50, 0.55, 0.60, 0.65, 0.70, 0.80), (1, 2, 3, 5), (0, 3, 5, 10)),
    "surprise": Grid((1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0), (1, 2, 3, 5), (0, 5, 10, 20)),
    "leave_previous": Grid((0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50), (1, 2, 3), (0, 3, 5, 10)),
    "total_variation": Grid((0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50), (1, 2, 3), (0, 3, 5, 10)),
}


def model_grid(intraday: bool = False, scaling: str = "zscore") -> list[tuple[int, feats.Feature]]:
    """Two and three regimes, five families; rolling windows start anew each session for intraday series."""
    families = [("log_return", 5), ("abs_return", 5), ("squared_return", 5), ("rolling_vol", 5), ("rolling_vol", 20)]
    return [(k, feats.Feature(f, w, intraday and f == "rolling_vol", scaling)) for k in (2, 3) for f, w in families]


ALARMED = f"{SERIES} string, point int, threshold double, required int, cooldown int, alarms array<bigint>, n bigint"


def alarm_grid(posterior: DataFrame, kind: str, grid: Grid, alpha: float | None = None, chunk: int = 32) -> DataFrame:
    """(series_id, point, threshold, required, cooldown, alarms, n): the alarms of each grid point over one set of filtered rows."""
    points = [(i, *p) for i, p in enumerate(grid.points())]
    chunks = [points[i : i + chunk] for i in range(0, len(points), chunk)]
    rows = posterior.select(SERIES, "t", "filtered", "log_c", F.explode(F.array(*[F.lit(i) for i in range(len(chunks))])).alias("chunk"))
    rows = rows.repartition(SERIES, "chunk").sortWithinPartitions(SERIES, "chunk", "t")
    names = [c.split(" ")[0] for c in ALARMED.split(", ")]

    def body(batches):
        now, n, before, of_point = None, 0, None, []

        def done():
            return pd.DataFrame([(now[0], *p, found, n) for p, _, found, *_ in of_point], columns=names)

        for pdf in batches:
            s, c = pdf[SERIES].to_numpy(object), pdf["chunk"].to_numpy()
            cut = (np.flatnonzero((s[1:] != s[:-1]) | (c[1:] != c[:-1])) + 1).tolist()
            for a, b in zip([0, *cut], [*cut, len(pdf)]):
                if a == b:
                    continue
                if (s[a], c[a]) != now:
                    if now is not None:
                        yield done()
                    now, n, before = (s[a], c[a]), 0, None
                    of_point = [[p, K.Detector(kind, *p[1:], alpha).check(), [], None, 0, 0] for p in chunks[c[a]]]
                f, lc = np.array(pdf["filtered"].iloc[a:b].tolist(), float), pdf["log_c"].to_numpy(float)[a:b]
                for state in of_point:
                    _, d, found, base, count, left = state
                    _, crossed, ready, state[3] = K.resume(d, f, lc, before, base)
                    alarm, state[4], state[5] = K.persist(crossed.tolist(), ready.tolist(), d.required, d.cooldown, count, left)
                    found.extend((np.flatnonzero(alarm) + 1 + n).tolist())
                n, before = n + b - a, f[-1]
        if now is not None:
            yield done()

    return rows.mapInPandas(body, ALARMED)


def score_synthetic(alarmed: DataFrame, truth: DataFrame, window: int = 20) -> DataFrame:
    """alarmed with coverage, precision and score = half of each, against change points (series_id, t); undefined shares count as 0."""
    taus = truth.groupBy(SERIES).agg(F.array_sort(F.collect_set("t")).alias("taus"))
    rows = alarmed.join(taus, SERIES, "left")

    @F.pandas_udf("bigint")
    def matched(taus: pd.Series, alarms: pd.Series) -> pd.Series:
        return pd.Series([len(K.match_events([] if t is None else list(t), list(a), window)) for t, a in zip(taus, alarms)])

    rows = rows.withColumn("hits", matched("taus", "alarms"))
    n_events, n_alarms = F.coalesce(F.size("taus"), F.lit(0)), F.size("alarms")
    coverage = F.when(n_events > 0, F.col("hits") / F.when(n_events > 0, n_events)).otherwise(0.0)
    precision = F.when(n_alarms > 0, F.col("hits") / F.when(n_alarms > 0, n_alarms)).otherwise(0.0)
    return rows.withColumns({"coverage": coverage, "precision": precision, "n_alarms": n_alarms.cast("long")}).withColumn("score", 0.5 * F.col("coverage") + 0.5 * F.col("precision")).drop("taus", "hits")


def rank(scored: DataFrame, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """rank from 1 by score, equal ones in the order of the grid; NaN last."""
    score = F.when(F.isnan("score"), F.lit(None)).otherwise(F.col("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), "point")))


def top(ranked: DataFrame, n: int = 10) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def search_models(prices: DataFrame, truth: DataFrame, models: list[tuple[int, feats.Feature]], kind: str, grid: Grid, window: int = 20, tol: float = 1e-6, max_iter: int = 200) -> DataFrame:
    """All models x grid points of each series, ranked: one fit a model. Columns model, k and family name the model; models are numbered in the order given.

    Each feature is built once. Models stand side by side as series of their own, named `model:series`, so one plan fits, filters and
    lays the grid for all of them."""
    rows = None
    for f in dict.fromkeys(f for _, f in models):
        mine = F.explode(F.array(*[F.lit(i) for i, (_, g) in enumerate(models) if g == f]))
        got = feats.stream(prices, f).select(SERIES, "t", "ts", "y", mine.alias("model"))
        rows = got if rows is None else rows.unionByName(got)
    ks = F.array(*[F.lit(k) for k, _ in models])
    rows = rows.select(F.concat("model", F.lit(":"), SERIES).alias(SERIES), "t", "ts", "y", ks[F.col("model")].alias("k"))
    params = None
    for k in sorted({k for k, _ in models}):
        got = hmm.best_fit(hmm.fit_em(rows.where(F.col("k") == k), k, tol, max_iter)).select(SERIES, "pi", "transition", "means", "variances")
        params = got if params is None else params.unionByName(got)
    laid = alarm_grid(hmm.filter_rows(hmm.spread(rows.drop("k")), params, move_first=True), kind, grid)
    parts = F.split(SERIES, ":", 2)
    laid = laid.withColumns({"model": parts[0].cast("int"), SERIES: parts[1]})
    labels = F.array(*[F.lit(f.label("")) for _, f in models])
    more = {"k": ks[F.col("model")], "family": labels[F.col("model")], "point": F.col("point") + F.col("model") * len(grid.points())}
    return rank(score_synthetic(laid, truth, window).withColumns(more))
