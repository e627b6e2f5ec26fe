"""Calibration of synthetic generators to real series: empirical summaries, parameter policies, and checks of what was simulated."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import finite, ratio
from .clean import SERIES
from .hmm import PARAMS, params_of

#: Fixed value: standard deviations between the median and the 95 % quantile of a normal distribution, as used for quantile anchors.
Z95 = 1.64485
SUMMARY = ("n", "mean", "variance", "std_dev", "q01", "q05", "q50", "q95", "q99", "tail_freq_q95", "abs_exceed_2std", "acf1", "abs_acf1", "sign_change_rate", "high_episode_mean", "low_episode_mean")


def _paired(obs: DataFrame, *by: str) -> DataFrame:
    """obs with b, the value before, in each series (and group of the columns `by`)."""
    return obs.select(SERIES, *by, "t", "y", F.lag("y").over(Window.partitionBy(SERIES, *by).orderBy("t")).alias("b"))


def _sign_changes() -> tuple[Column, Column]:
    """(changes, pairs that count) of rows (y, b)."""
    counts = (F.col("y") != 0) & (F.col("b") != 0) & F.col("b").isNotNull()
    return F.sum((counts & ((F.col("y") > 0) != (F.col("b") > 0))).cast("long")), F.sum(counts.cast("long"))


def _episodes(threshold: Column) -> tuple[Column, Column]:
    """Mean lengths of runs of |y| above, and not above, |threshold| of rows (y, b): rows over first rows of runs; 0 without such runs."""
    high, before = F.abs("y") > F.abs(threshold), F.abs("b") > F.abs(threshold)
    first = F.coalesce(before != high, F.lit(True))
    n = lambda c: F.sum(c.cast("long"))
    return tuple(F.coalesce(n(c) / F.nullif(n(c & first), F.lit(0).cast("long")), F.lit(0.0)) for c in (high, ~high))


def sign_change_rate(obs: DataFrame) -> DataFrame:
    """(series_id, sign_change_rate): share of neighbours with unlike signs; pairs with a zero don't count, none at all gives 0."""
    c, n = _sign_changes()
    return _paired(obs).groupBy(SERIES).agg(n.alias("n"), c.alias("c")).select(SERIES, ratio("c", "n", 0.0).alias("sign_change_rate"))


def episode_means(obs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(series_id, high_episode_mean, low_episode_mean): mean lengths of runs of |y| above, and not above, |threshold|; 0 without such runs."""
    high, low = _episodes(F.col("threshold"))
    return _paired(obs).join(thresholds.select(SERIES, "threshold"), SERIES).groupBy(SERIES).agg(high.alias("high_episode_mean"), low.alias("low_episode_mean"))


#: What moments gives of SUMMARY.
MOMENTS = ("n", "mean", "variance", "std_dev", "q01", "q05", "q50", "q95", "q99", "acf1", "abs_acf1", "sign_change_rate")


def moments(obs: DataFrame, *by: str) -> DataFrame:
    """One row a series (and group of the columns `by`) with MOMENTS, of the finite values in the order of t: one window and one aggregate.

    The sum of products about the mean, over neighbours, comes from their covariance and the distance of their means from the mean of all."""
    keys = (SERIES, *by)
    rows = _paired(obs.where(finite("y")), *by).withColumns({"s": F.abs("y"), "sb": F.abs("b")})
    qs = F.percentile("y", F.array(*[F.lit(q) for q in (0.01, 0.05, 0.5, 0.95, 0.99)]))
    changes, pairs = _sign_changes()
    lags = [x for y, b, c in (("y", "b", "acf"), ("s", "sb", "abs")) for x in (F.avg(y).alias(f"{c}_m"), F.var_pop(y).alias(f"{c}_v"), F.covar_pop(y, b).alias(f"{c}_c"), F.avg(F.when(F.col(b).isNotNull(), F.col(y))).alias(f"{c}_y"), F.avg(b).alias(f"{c}_b"))]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("y").alias("std_dev"), qs.alias("q"), F.count("b").alias("np"), changes.alias("changes"), pairs.alias("pairs"), *lags)

    def lagged(c: str) -> Column:
        num = F.col("np") * (F.col(f"{c}_c") + (F.col(f"{c}_y") - F.col(f"{c}_m")) * (F.col(f"{c}_b") - F.col(f"{c}_m")))
        return F.coalesce(ratio(num, F.col("n") * F.col(f"{c}_v")), F.lit(0.0))

    return out.select(*keys, "n", F.col("acf_m").alias("mean"), F.col("acf_v").alias("variance"), "std_dev", *[F.col("q")[i].alias(c) for i, c in enumerate(MOMENTS[4:9])], lagged("acf").alias("acf1"), lagged("abs").alias("abs_acf1"), ratio("changes", "pairs", 0.0).alias("sign_change_rate"))


def empirical_summary(obs: DataFrame) -> DataFrame:
    """One row a series with SUMMARY, of the finite values in the order of t. A series without finite value has no row."""
    base = moments(obs)
    rows = _paired(obs.where(finite("y"))).join(base.select(SERIES, "q95", "std_dev"), SERIES)
    high, low = _episodes(F.col("q95"))
    tails = rows.groupBy(SERIES).agg(F.avg((F.col("y") > F.col("q95")).cast("double")).alias("tail_freq_q95"), F.avg(((F.col("std_dev") > 0) & (F.abs("y") > 2 * F.col("std_dev"))).cast("double")).alias("abs_exceed_2std"), high.alias("high_episode_mean"), low.alias("low_episode_mean"))
    return base.join(tails, SERIES).select(SERIES, *SUMMARY)


@dataclass(frozen=True)
class Mapping:
    """How a summary becomes parameters: k regimes, policies for means (zero_centered, symmetric, baseline) and variances
    (quantile_anchored, ratio, magnitude_conditioned), durations (inferred if empty) and the least ratio of the deviations."""

    k: int = 2
    horizon: int = 2000
    means: str = "zero_centered"
    variances: str = "quantile_anchored"
    low_mult: float = 0.5
    high_mult: float = 2.0
    durations: tuple[float, ...] = ()
    symmetric: bool = True
    min_ratio: float = 1.0
    strategy: str = "summary"
    fitted_pi: bool = False

    def check(self) -> Mapping:
        if self.k < 2 or self.horizon < 2:
            raise ValueError("at least two regimes and a horizon of two are needed")
        if self.durations and len(self.durations) != self.k:
            raise ValueError("as many durations as regimes are needed")
        if self.low_mult <= 0 or self.high_mult <= 0:
            raise ValueError("variance multipliers must be above zero")
        return self


def map_means(s: dict, m: Mapping) -> list[float]:
    """Regime means about zero or the empirical mean: half a deviation apart for two regimes and for more."""
    if m.means == "baseline":
        return [s["mean"]] * m.k
    centre = s["mean"] if m.means == "symmetric" else 0.0
    step = 0.5 * s["std_dev"]
    return [centre + (i - (m.k - 1) / 2) * step for i in range(m.k)]


def map_variances(s: dict, m: Mapping, values: np.ndarray | None = None) -> list[float]:
    """Variances from calm to turbulent."""
    variance = max(s["variance"], 1e-12)
    share = np.arange(m.k) / (m.k - 1)
    if m.variances == "ratio":
        out = variance * (m.low_mult + share * (m.high_mult - m.low_mult))
    else:
        if m.variances == "magnitude_conditioned" and values is not None and len(values):
            size = np.abs(values)
            middle = np.sort(size)[len(size) // 2]
            halves = [values[size <= middle], values[size > middle]]
            low, high = (math.sqrt(max(h.var(), 1e-12)) if len(h) else math.sqrt(variance) for h in halves)
        else:
            low, high = max(abs(s["q50"] - s["q05"]) / Z95, 1e-6), max(abs(s["q95"] - s["q50"]) / Z95, 1e-6)
        out = (low + share * (high - low)) ** 2
    out = np.sort(out)
    if out[0] == out[-1]:
        out = (max(math.sqrt(variance), 1e-6) * (1 + 0.1 * np.arange(m.k))) ** 2
    spread = max(math.sqrt(out[-1] / out[0]), 1.0)
    if m.variances != "ratio" and m.min_ratio > 1 and spread < m.min_ratio:
        out = out * (m.min_ratio / spread) ** (2 * share - 1)  # alpha**2, alpha the root of the missing ratio
    return out.tolist()


def infer_durations(s: dict, k: int) -> list[float]:
    """Mean run lengths, at least two bars, from the calm regime to the turbulent one."""
    low, high = max(s["low_episode_mean"], 2.0), max(s["high_episode_mean"], 2.0)
    return [low + i / (k - 1) * (high - low) for i in range(k)]


def durations_to_rows(durations: list[float], symmetric: bool = True) -> np.ndarray:
    """Transition rows with p = 1 - 1/d on the diagonal; the rest spread evenly, or all to the next regime."""
    k = len(durations)
    if k < 2 or any(not math.isfinite(d) or d <= 1 for d in durations):
        raise ValueError("at least two durations, finite and above one bar, are needed")
    rows = np.zeros((k, k))
    for i, d in enumerate(durations):
        stay = min(max(1 - 1 / d, 1e-6), 1 - 1e-6)
        if symmetric:
            rows[i] = (1 - stay) / (k - 1)
        else:
            rows[i, (i + 1) % k] = 1 - stay
        rows[i, i] = stay
    return rows


def from_summary(s: dict, m: Mapping, values: np.ndarray | None = None) -> K.Params:
    m.check()
    rows = durations_to_rows(list(m.durations) or infer_durations(s, m.k), m.symmetric)
    return K.Params(K.stationary(rows), rows, map_means(s, m), map_variances(s, m, values)).check()


def quick_em(values: np.ndarray, m: Mapping, tol: float = 1e-6, max_iter: int = 100) -> tuple[K.Params, K.Fit]:
    """Parameters of a fit to the finite values, regimes from calm to turbulent; pi is the fitted one or the stationary one."""
    y = values[np.isfinite(values)]
    fit = K.fit_em(y, K.initial_params(y, m.k), tol, max_iter)
    o = np.argsort(fit.params.variances, kind="stable")
    rows = fit.params.transition[np.ix_(o, o)]
    return K.Params(fit.params.pi[o] if m.fitted_pi else K.stationary(rows), rows, fit.params.means[o], fit.params.variances[o]), fit


def calibrated_params(obs: DataFrame, m: Mapping) -> DataFrame:
    """(series_id, parameters, expected_durations) of each series by the strategy: from its summary, or by a quick fit."""
    m.check()
    out = f"{SERIES} string, {PARAMS}, expected_durations array<double>"
    if m.strategy == "quick_em" or m.variances == "magnitude_conditioned":

        def body(pdf: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(rows):
                return pd.DataFrame({c.split(" ")[0]: [] for c in out.split(", ")})
            y = pdf.sort_values("t")["y"].to_numpy(float)
            y = y[np.isfinite(y)]
            p = quick_em(y, m)[0] if m.strategy == "quick_em" else from_summary(rows.iloc[0].to_dict(), m, y)
            return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], **p.row(), "expected_durations": (1 / (1 - np.diag(p.transition))).tolist()}])

        own = empirical_summary(obs).withColumn(SERIES, F.concat(SERIES, F.lit("")))  # a key of its own, or the two sides' keys are one
        return obs.select(SERIES, "t", "y").groupBy(SERIES).cogroup(own.groupBy(SERIES)).applyInPandas(body, out)

    def each(batches):
        for pdf in batches:
            rows = []
            for s in pdf.to_dict("records"):
                p = from_summary(s, m)
                rows.append({SERIES: s[SERIES], **p.row(), "expected_durations": list(m.durations) or infer_durations(s, m.k)})
            if rows:
                yield pd.DataFrame(rows)

    return empirical_summary(obs).mapInPandas(each, out)


#: Tolerances of the verification, as (field, tolerance, relative).
TOLERANCES = (("mean", 0.25, False), ("variance", 0.50, True), ("q05", 0.30, False), ("q95", 0.30, False), ("abs_acf1", 0.20, False), ("sign_change_rate", 0.20, False))


def halves(groups: DataFrame, fields: tuple[str, ...], of: str, real, synthetic) -> DataFrame:
    """(series_id, r_*, s_*) of summaries by (series_id, of), for series with both the real and the synthetic group, without a join."""
    pick = lambda g: F.max(F.when(F.col(of) == g, F.struct(*fields)))
    both = groups.groupBy(SERIES).agg(pick(real).alias("r"), pick(synthetic).alias("s")).where("r IS NOT NULL AND s IS NOT NULL")
    return both.select(SERIES, *[F.col(f"{x}.{f}").alias(f"{x}_{f}") for x in "rs" for f in fields])


def joined(real: DataFrame, synthetic: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(series_id, r_*, s_*) of a real and a synthetic summary."""
    r, s = (df.select(SERIES, *[F.col(f).alias(f"{x}_{f}") for f in fields]) for x, df in (("r", real), ("s", synthetic)))
    return r.join(s, SERIES)


def scale_check(both: DataFrame, limit: float = 0.10) -> DataFrame:
    """(series_id, real_std, synthetic_std, relative_error, ok) of (series_id, r_std_dev, s_std_dev)."""
    rows = both.select(SERIES, F.col("r_std_dev").alias("real_std"), F.col("s_std_dev").alias("synthetic_std"))
    error = ratio(F.abs(F.col("synthetic_std") - F.col("real_std")), F.col("real_std"), float("inf"))
    return rows.select(SERIES, "real_std", "synthetic_std", error.alias("relative_error"), (error <= limit).alias("ok"))


#: What verify compares.
FIELDS = tuple(f for f, _, _ in TOLERANCES)


def verify(both: DataFrame, m: Mapping | None = None, tolerances=TOLERANCES) -> DataFrame:
    """(series_id, field, real, synthetic, error, tolerance, ok) of (series_id, r_*, s_*): fields that the mapping doesn't aim at (the mean if
    zero-centred, the persistence figures after a quick fit) are left out."""
    masked = set()
    if m is not None and m.strategy == "quick_em":
        masked = {"abs_acf1", "sign_change_rate"}
    elif m is not None and m.means == "zero_centered":
        masked = {"mean"}
    used = [t for t in tolerances if t[0] not in masked]

    def cell(f: str, tol: float, relative: bool):
        diff = F.abs(F.col(f"s_{f}") - F.col(f"r_{f}"))
        error = diff / F.greatest(F.abs(F.col(f"r_{f}")), F.lit(1e-12)) if relative else diff
        return F.struct(F.lit(f).alias("field"), F.col(f"r_{f}").alias("real"), F.col(f"s_{f}").alias("synthetic"), error.alias("error"), F.lit(tol).alias("tolerance"), (error <= tol).alias("ok"))

    return both.select(SERIES, F.explode(F.array(*[cell(*t) for t in used])).alias("c")).select(SERIES, "c.*")


def workflow(obs: DataFrame, m: Mapping, seed: int = 42, jump_prob: float = 0.0, jump_scale: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parameters, simulated rows, verification): summary, mapping, simulation, summary again, comparison."""
    params = calibrated_params(obs, m)

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        rng = np.random.Generator(np.random.PCG64([seed, *r[SERIES].encode()]))
        states, y = K.simulate(params_of(r), m.horizon, rng, jump_prob, jump_scale)
        return pd.DataFrame({SERIES: r[SERIES], "t": np.arange(1, len(y) + 1), "state": states, "y": y})

    simulated = params.groupBy(SERIES).applyInPandas(body, f"{SERIES} string, t bigint, state bigint, y double")
    return params, simulated, verify(joined(moments(obs), moments(simulated), FIELDS), m)
