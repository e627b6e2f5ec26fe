"""Gaussian Markov-switching models over (series_id, t, ts, y) rows.

One series at a time goes through the kernels, in a grouped pandas function; series run side by side. What needs only a
neighbouring row (pairwise posteriors, expected transitions, change points) stays a window or an aggregate. A
series that is too long for one task takes the blocked scan of operators.scan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import log_density
from .clean import SERIES

PARAMS = "k int, pi array<double>, transition array<array<double>>, means array<double>, variances array<double>"
POSTERIOR = f"{SERIES} string, t bigint, ts timestamp_ntz, y double, predicted array<double>, filtered array<double>, log_c double"


def params_of(row) -> K.Params:
    return K.Params(np.array(row["pi"], float), np.array([list(r) for r in row["transition"]], float), np.array(row["means"], float), np.array(row["variances"], float))


def per_series(obs: DataFrame, params: K.Params | DataFrame, body: Callable[[pd.DataFrame, K.Params], pd.DataFrame], out: str) -> DataFrame:
    """body over each series in the order of t, with the same parameters for all or those of the series; series without parameters are left out."""
    if isinstance(params, K.Params):
        return obs.groupBy(SERIES).applyInPandas(lambda pdf: body(pdf.sort_values("t", ignore_index=True), params), out)

    empty = pd.DataFrame({c.split(" ")[0]: [] for c in _split(out)})

    def both(pdf: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(rows):
            return empty
        return body(pdf.sort_values("t", ignore_index=True), params_of(rows.iloc[0]))

    return obs.groupBy(SERIES).cogroup(params.groupBy(SERIES)).applyInPandas(both, out)


def _split(out: str) -> list[str]:
    return [x.strip() for x in out.split(", ")]


def _frame(pdf: pd.DataFrame, f: K.Filtered, **more) -> pd.DataFrame:
    return pd.DataFrame({SERIES: pdf[SERIES], "t": pdf["t"], "ts": pdf["ts"], "y": pdf["y"], "predicted": list(f.predicted), "filtered": list(f.filtered), "log_c": f.log_c, **more})


def filter_rows(obs: DataFrame, params: K.Params | DataFrame, move_first: bool = False) -> DataFrame:
    """Predicted and filtered probabilities and ln c of each row; move_first as the online filter does."""
    return per_series(obs, params, lambda pdf, p: _frame(pdf, K.forward_filter(p.check(), pdf["y"].to_numpy(), move_first)), POSTERIOR)


def smooth_rows(obs: DataFrame, params: K.Params | DataFrame) -> DataFrame:
    """filter_rows and the smoothed probabilities."""

    def body(pdf: pd.DataFrame, p: K.Params) -> pd.DataFrame:
        f = K.forward_filter(p.check(), pdf["y"].to_numpy())
        return _frame(pdf, f, smoothed=list(K.smooth(p, f)))

    return per_series(obs, params, body, POSTERIOR + ", smoothed array<double>")


def log_likelihood(posterior: DataFrame) -> DataFrame:
    return posterior.groupBy(SERIES).agg(F.count("*").alias("n"), F.sum("log_c").alias("log_likelihood"))


def emission(obs: DataFrame, p: K.Params) -> DataFrame:
    """Log density of each row under each regime."""
    return obs.withColumns({f"log_density_{j}": log_density("y", float(m), float(v)) for j, (m, v) in enumerate(zip(p.means, p.variances))})


def pairwise(smoothed: DataFrame, transition: np.ndarray) -> DataFrame:
    """(series_id, t, xi) for t from 2: the posterior of each pair of consecutive regimes, a projection over the row before."""
    w = Window.partitionBy(SERIES).orderBy("t")
    rows = smoothed.withColumn("__before", F.lag("filtered").over(w)).where("__before IS NOT NULL")
    k = len(transition)

    def entry(i: int, j: int) -> Column:
        pred = F.col("predicted")[j]
        return F.when(pred < K.RATIO_FLOOR, F.lit(0.0)).otherwise(F.col("__before")[i] * F.lit(float(transition[i][j])) * F.col("smoothed")[j] / F.greatest(pred, F.lit(K.RATIO_FLOOR)))

    return rows.select(SERIES, "t", F.array(*[F.array(*[entry(i, j) for j in range(k)]) for i in range(k)]).alias("xi"))


def expected_transitions(xi: DataFrame, k: int) -> DataFrame:
    """(series_id, from_regime, to_regime, expected)."""
    sums = xi.groupBy(SERIES).agg(*[F.sum(F.col("xi")[i][j]).alias(f"x{i}_{j}") for i in range(k) for j in range(k)])
    cells = [F.struct(F.lit(i).alias("from_regime"), F.lit(j).alias("to_regime"), F.col(f"x{i}_{j}").alias("expected")) for i in range(k) for j in range(k)]
    return sums.select(SERIES, F.explode(F.array(*cells)).alias("c")).select(SERIES, "c.*")


def initial_params(obs: DataFrame, k: int) -> DataFrame:
    """Start values of each series: k runs of its sorted values (the last takes the rest), persistent transitions."""
    w = Window.partitionBy(SERIES)
    rows = obs.select(SERIES, "y", (F.row_number().over(w.orderBy("y")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    bucket = F.least(F.floor(F.col("i") / F.greatest(F.floor(F.col("n") / k), F.lit(1))), F.lit(k - 1)).cast("int")
    each = rows.groupBy(SERIES, bucket.alias("j")).agg(F.avg("y").alias("mean"), F.greatest(F.var_pop("y"), F.lit(K.VARIANCE_FLOOR)).alias("variance"))
    lists = each.groupBy(SERIES).agg(F.array_sort(F.collect_list(F.struct("j", "mean", "variance"))).alias("r"))
    diagonal = F.array(*[F.array(*[F.lit(0.9 if a == b else 0.1 / (k - 1)) for b in range(k)]) for a in range(k)])
    return lists.select(SERIES, F.lit(k).alias("k"), F.array(*[F.lit(1.0 / k)] * k).alias("pi"), diagonal.alias("transition"), F.col("r.mean").alias("means"), F.col("r.variance").alias("variances"))


FIT = f"{SERIES} string, start int, {PARAMS}, log_likelihood double, n_iter int, converged boolean, history array<double>"


def spread(obs: DataFrame, *more: str) -> DataFrame:
    """obs by series (and more columns) in more tasks than shuffles have: a fit takes far longer than the bytes of its rows let on, so its tasks aren't to be
    merged by size. A shuffle of the same number would be taken for the one below it, which is merged."""
    return obs.repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, SERIES, *more)


def fit_em(obs: DataFrame, k: int, tol: float = 1e-6, max_iter: int = 1000, n_starts: int = 1, jitter: float = 0.0, seed: int = 42) -> DataFrame:
    """Fits of each series, one row a start. Starts are alike unless jitter (in standard deviations) moves the means of all but the first; they run side by side."""

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        y, s = pdf.sort_values("t")["y"].to_numpy(float), int(pdf["start"].iloc[0])
        p = K.initial_params(y, k)
        if s and jitter:
            rng = np.random.Generator(np.random.PCG64([seed, s]))
            p = K.Params(p.pi, p.transition, p.means + jitter * y.std() * rng.standard_normal(k), p.variances)
        fit = K.fit_em(y, p, tol, max_iter)
        return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], "start": s, **fit.params.row(), "log_likelihood": fit.log_likelihood, "n_iter": fit.n_iter, "converged": fit.converged, "history": fit.history}])

    starts = obs.select(SERIES, "t", "y", F.explode(F.array(*[F.lit(s) for s in range(n_starts)])).alias("start"))
    return spread(starts, "start").groupBy(SERIES, "start").applyInPandas(body, FIT)


def best_fit(fits: DataFrame) -> DataFrame:
    """The start with the greatest log-likelihood, the last one of a tie."""
    w = Window.partitionBy(SERIES).orderBy(F.desc("log_likelihood"), F.desc("start"))
    return fits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def em_step(obs: DataFrame, p: K.Params) -> DataFrame:
    """Parameters after one E and one M step from the same start, as one row a series."""

    def body(pdf: pd.DataFrame, p: K.Params) -> pd.DataFrame:
        y = pdf["y"].to_numpy(float)
        f = K.forward_filter(p, y)
        s = K.smooth(p, f)
        new = K.m_step(y, s, K.pairwise(p, f, s).sum(0), p)
        return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], **new.row(), "log_likelihood": f.log_likelihood}])

    return per_series(obs, p, body, f"{SERIES} string, {PARAMS}, log_likelihood double")


def change_points(states: DataFrame) -> DataFrame:
    """(series_id, t) where the state differs from the row before."""
    before = F.lag("state").over(Window.partitionBy(SERIES).orderBy("t"))
    return states.withColumn("__b", before).where(F.col("__b") != F.col("state")).select(SERIES, "t")


def simulate(spark, scenarios: list[tuple[str, K.Params, int, int, float, float]]) -> DataFrame:
    """(series_id, t, state, y) of scenarios (id, parameters, length, seed, jump probability, jump scale); one task a scenario."""
    rows = [(s, t, seed, jp, js, *p.row().values()) for s, p, t, seed, jp, js in scenarios]
    plan = spark.createDataFrame(rows, f"{SERIES} string, length bigint, seed bigint, jump_prob double, jump_scale double, {PARAMS}")

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        states, y = K.simulate(params_of(r), int(r["length"]), np.random.Generator(np.random.PCG64(int(r["seed"]))), float(r["jump_prob"]), float(r["jump_scale"]))
        return pd.DataFrame({SERIES: r[SERIES], "t": np.arange(1, len(y) + 1), "state": states, "y": y})

    return plan.groupBy(SERIES).applyInPandas(body, f"{SERIES} string, t bigint, state bigint, y double")


#: The built-in scenarios.
SCENARIOS: dict[str, K.Params] = {
    "scenario_calibrated": K.Params([0.5, 0.5], [[0.96, 0.04], [0.12, 0.88]], [0.0002, -0.0001], [0.0001, 0.0004]),
    "persistent_states": K.Params([0.5, 0.5], [[0.975, 0.025], [0.067, 0.933]], [0.0001, -0.0001], [0.00008, 0.00032]),
    "shock_contaminated": K.Params([0.5, 0.5], [[0.96, 0.04], [0.12, 0.88]], [0.0002, -0.0005], [0.0001, 0.0016]),
    "three_regimes": K.Params([0.34, 0.33, 0.33], [[0.971, 0.020, 0.009], [0.013, 0.930, 0.057], [0.007, 0.136, 0.857]], [0.0003, 0.0, -0.0002], [0.00009, 0.00018, 0.0004]),
}


def scenario(name: str | None, k: int = 2) -> K.Params:
    """By name; any other name is the three-regime scenario for k = 3 and the calibrated one otherwise."""
    if name in SCENARIOS and name != "three_regimes":
        return SCENARIOS[name]
    if name not in ("", None, "calm_turbulent") and k == 3:
        return SCENARIOS["three_regimes"]
    return SCENARIOS["scenario_calibrated"]


def regime_summary(smoothed: DataFrame, p: K.Params) -> DataFrame:
    """(series_id, regime, occupancy, hard_count, self_prob, expected_duration, mean, variance)."""
    from ..functions.columns import dominant

    rows = smoothed.select(SERIES, dominant("smoothed").alias("top"), F.posexplode("smoothed").alias("regime", "g"))
    out = rows.groupBy(SERIES, "regime").agg(F.avg("g").alias("occupancy"), F.sum((F.col("top") == F.col("regime")).cast("long")).alias("hard_count"))

    def of(values) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])[F.col("regime")]

    stay = np.diag(p.transition)
    duration = [1 / (1 - x) if abs(1 - x) >= np.finfo(float).eps else float("inf") for x in stay]
    return out.withColumns({"self_prob": of(stay), "expected_duration": of(duration), "mean": of(p.means), "variance": of(p.variances)})


def posterior_validity(smoothed: DataFrame, xi: DataFrame) -> DataFrame:
    """(series_id, max_filtered_dev, max_smoothed_dev, max_xi_dev, max_marginal_dev): largest deviations of sums from one, and of xi's margins from the smoothed probabilities."""

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    rows = smoothed.join(xi, [SERIES, "t"], "left")
    all_xi = F.aggregate(F.flatten("xi"), F.lit(0.0), lambda a, x: a + x)
    columns = F.transform(F.sequence(F.lit(0), F.size("smoothed") - 1), lambda j: F.abs(F.aggregate("xi", F.lit(0.0), lambda a, r: a + r[j]) - F.col("smoothed")[j]))
    return rows.groupBy(SERIES).agg(F.max(F.abs(total("filtered") - 1)).alias("max_filtered_dev"), F.max(F.abs(total("smoothed") - 1)).alias("max_smoothed_dev"), F.max(F.abs(all_xi - 1)).alias("max_xi_dev"), F.max(F.array_max(columns)).alias("max_marginal_dev"))


def param_validity(fits: DataFrame) -> DataFrame:
    """(series_id, start, pi_dev, row_dev, finite, positive_variances)."""

    def total(c) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    ok = lambda c: F.forall(c, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return fits.select(SERIES, "start", F.abs(total("pi") - 1).alias("pi_dev"), F.array_max(F.transform("transition", lambda r: F.abs(total(r) - 1))).alias("row_dev"), (ok("pi") & ok(F.flatten("transition")) & ok("means") & ok("variances")).alias("finite"), F.forall("variances", lambda v: v > 0).alias("positive_variances"))


def convergence(fits: DataFrame) -> DataFrame:
    """(series_id, start, gain, min_delta, largest_drop, monotone) of the log-likelihood histories."""
    rows = fits.select(SERIES, "start", F.posexplode("history").alias("i", "ll"))
    step = F.col("ll") - F.lag("ll").over(Window.partitionBy(SERIES, "start").orderBy("i"))
    rows = rows.withColumn("d", step)
    return rows.groupBy(SERIES, "start").agg((F.max_by("ll", "i") - F.min_by("ll", "i")).alias("gain"), F.min("d").alias("min_delta"), F.greatest(-F.min("d"), F.lit(0.0)).alias("largest_drop"), F.coalesce(F.min("d") >= -DROP_TOL, F.lit(True)).alias("monotone"))


#: Bounds beyond which a fit is suspect.
NEAR_ZERO_VARIANCE, RARE_SHARE, ABSORBING, UNSTABLE_SPREAD, DROP_TOL = 1e-4, 0.01, 1 - 1e-6, 1.0, 1e-8


def _warn(kind: str, value, regime: Column | None = None) -> Column:
    regime = F.lit(None) if regime is None else regime
    return F.struct(F.lit(kind).alias("kind"), regime.cast("int").alias("regime"), value.alias("value"))


def _where(c: Column, x: Column) -> Column:
    return F.when(c, F.array(x)).otherwise(F.slice(F.array(x), 1, 0))


def _of_regime(of: Callable[[str], Column]) -> Column:
    """What is suspect about a regime, as a list; of: its fields by name."""
    v, o, p = of("variance"), of("occupancy"), of("self_prob")
    kinds = [(v < NEAR_ZERO_VARIANCE, "near_zero_variance", v), (o < RARE_SHARE, "nearly_unused_regime", o), (p > ABSORBING, "suspicious_persistence", p)]
    return F.concat(*[_where(c, _warn(kind, x, of("regime"))) for c, kind, x in kinds])


def _runs(fits: DataFrame, *more: Column) -> DataFrame:
    """(series_id, spread, drops, more) of all starts: their largest loss of likelihood each, where they lost any."""
    steps = F.transform(F.sequence(F.lit(1), F.size("history") - 1), lambda i: F.get("history", i) - F.get("history", i - 1))
    runs = fits.withColumn("least", F.when(F.size("history") > 1, F.array_min(steps))).groupBy(SERIES)
    return runs.agg((F.max("log_likelihood") - F.min("log_likelihood")).alias("spread"), F.collect_list(F.when(~(F.col("least") >= -DROP_TOL), -F.col("least"))).alias("drops"), *more)


def _of_runs() -> Column:
    return F.concat(F.transform("drops", lambda x: _warn("em_non_monotonicity", x)), _where(F.col("spread") > UNSTABLE_SPREAD, _warn("unstable_across_starts", F.col("spread"))))


def _found(rows: DataFrame, lists: Column) -> DataFrame:
    return rows.select(SERIES, F.explode(lists).alias("w")).select(SERIES, "w.*")


def warnings(fits: DataFrame, regimes: DataFrame) -> DataFrame:
    """(series_id, kind, regime, value) of what is suspect about fits: variances near zero, regimes hardly used or never left, lost likelihood, starts that disagree.

    regimes: those of the fitted parameters. fits and regimes are read once each: what they come from takes long, and a union would run it for each of its parts."""
    return _found(regimes, _of_regime(F.col)).unionByName(_found(_runs(fits), _of_runs()))


REGIME = "struct<regime:int,occupancy:double,hard_count:bigint,self_prob:double,expected_duration:double,mean:double,variance:double>"


def _regimes(p: K.Params, s: np.ndarray) -> list[dict]:
    stay, top = np.diag(p.transition), K.dominant(s)
    lasts = [1 / (1 - x) if abs(1 - x) >= np.finfo(float).eps else float("inf") for x in stay]
    return [{"regime": j, "occupancy": float(s[:, j].mean()), "hard_count": int((top == j).sum()), "self_prob": float(stay[j]), "expected_duration": float(lasts[j]), "mean": float(p.means[j]), "variance": float(p.variances[j])} for j in range(p.k)]


def regimes(obs: DataFrame, params: K.Params | DataFrame) -> DataFrame:
    """As regime_summary of smooth_rows, summed up where a series is smoothed: no row leaves with its probabilities."""

    def body(pdf: pd.DataFrame, p: K.Params) -> pd.DataFrame:
        return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], **r} for r in _regimes(p, K.smooth(p, K.forward_filter(p.check(), pdf["y"].to_numpy(float))))])

    return per_series(obs.select(SERIES, "t", "y"), params, body, f"{SERIES} string, {REGIME[7:-1].replace(':', ' ').replace(',', ', ')}")


def fit_warnings(obs: DataFrame, fits: DataFrame) -> DataFrame:
    """warnings of fits, with the regimes of each series' best one: its parameters go over the series once more.

    Regimes come from fits, which are to be made once all the same, so what their histories tell goes along with the best one's parameters.
    A series without a fit or without rows has no warnings."""
    best = F.max_by(F.struct("pi", "transition", "means", "variances"), F.struct("log_likelihood", "start")).alias("best")
    runs = _runs(fits, best).select(SERIES, F.struct("spread", "drops", "best").alias("run"))
    out = f"{SERIES} string, spread double, drops array<double>, regimes array<{REGIME}>"

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        of_fit = pdf["t"].isna()
        y = pdf.loc[~of_fit, ["t", "y"]].sort_values("t")["y"].to_numpy(float)
        if not len(y) or not of_fit.any():
            return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], "spread": None, "drops": None, "regimes": None}])
        run = pdf.loc[of_fit, "run"].iloc[0]
        p = params_of(run["best"])
        return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], "spread": run["spread"], "drops": list(run["drops"]), "regimes": _regimes(p, K.smooth(p, K.forward_filter(p, y)))}])

    rows = obs.where("t IS NOT NULL").select(SERIES, "t", "y").unionByName(runs, allowMissingColumns=True).groupBy(SERIES).applyInPandas(body, out)
    return _found(rows, F.concat(F.flatten(F.transform("regimes", lambda r: _of_regime(lambda c: r[c]))), _of_runs()))


DEVIATIONS = ("max_filtered_dev", "max_smoothed_dev", "max_xi_dev", "max_marginal_dev")

#: Fixed value: the largest deviation of a posterior's sums that a trustworthy fit may have.
POSTERIOR_TOL = 1e-8


def diagnose(obs: DataFrame, fits: DataFrame) -> DataFrame:
    """One row a series for its best fit: valid, the posterior's deviations, the convergence summary, regimes, warnings, trustworthy.

    The fitted parameters go over the series once more; trustworthy asks for valid parameters and a posterior whose sums hold.
    A series without a fit is left out; one of a single row has no pair of regimes, whose deviations are 0 then."""
    best = best_fit(fits)
    checked = param_validity(best)
    valid = checked.select(SERIES, (F.col("finite") & F.col("positive_variances") & (F.col("pi_dev") <= K.SIMPLEX_TOL) & (F.col("row_dev") <= K.SIMPLEX_TOL)).alias("valid"))

    def body(pdf: pd.DataFrame, p: K.Params) -> pd.DataFrame:
        f = K.forward_filter(p, pdf["y"].to_numpy(float))
        s = K.smooth(p, f)
        xi = K.pairwise(p, f, s)
        sums = [f.filtered.sum(1) - 1, s.sum(1) - 1, xi.sum((1, 2)) - 1, xi.sum(1) - s[1:]]
        regimes = _regimes(p, s)
        return pd.DataFrame([{SERIES: pdf[SERIES].iloc[0], **{c: float(np.abs(x).max(initial=0.0)) for c, x in zip(DEVIATIONS, sums)}, "regimes": regimes}])

    passed = per_series(obs, best.select(SERIES, "pi", "transition", "means", "variances"), body, f"{SERIES} string, {', '.join(f'{c} double' for c in DEVIATIONS)}, regimes array<{REGIME}>")
    found = warnings(best, passed.select(SERIES, F.explode("regimes").alias("r")).select(SERIES, "r.*"))
    found = found.groupBy(SERIES).agg(F.array_sort(F.collect_list(F.struct("kind", "regime", "value"))).alias("warnings"))
    rows = best.select(SERIES, "start", "n_iter", "converged").join(valid, SERIES).join(passed, SERIES).join(convergence(best).drop("start"), SERIES).join(found, SERIES, "left")
    holds = F.col("valid")
    for c in DEVIATIONS:
        holds = holds & (F.col(c) < POSTERIOR_TOL)
    return rows.withColumns({"warnings": F.coalesce("warnings", F.array().cast("array<struct<kind:string,regime:int,value:double>>")), "trustworthy": holds})


def compare_runs(fits: DataFrame) -> DataFrame:
    """(series_id, n_runs, best, spread, top2_gap, unstable): by log-likelihood; unstable beyond a spread of one."""
    ranked = fits.withColumn("__r", F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc("log_likelihood"), F.desc("start"))))
    second = F.max(F.when(F.col("__r") == 2, F.col("log_likelihood")))
    out = ranked.groupBy(SERIES).agg(F.count("*").alias("n_runs"), F.max("log_likelihood").alias("best"), (F.max("log_likelihood") - F.min("log_likelihood")).alias("spread"), (F.max("log_likelihood") - second).alias("top2_gap"))
    return out.withColumn("unstable", F.col("spread") > UNSTABLE_SPREAD)


def by_mean(fits: DataFrame) -> DataFrame:
    """Regimes renumbered by their means, so that fits can be compared."""
    order = F.transform(F.array_sort(F.transform("means", lambda m, i: F.named_struct(F.lit("m"), m, F.lit("i"), i))), lambda x: x["i"])

    def pick(c, o) -> Column:
        return F.transform(o, lambda i: F.get(c, i))

    rows = fits.withColumn("__o", order)
    return rows.withColumns({"pi": pick(F.col("pi"), F.col("__o")), "means": pick(F.col("means"), F.col("__o")), "variances": pick(F.col("variances"), F.col("__o")), "transition": F.transform("__o", lambda i: F.transform("__o", lambda j: F.get(F.get("transition", i), j)))}).drop("__o")
