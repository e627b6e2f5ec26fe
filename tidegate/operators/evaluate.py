"""Evaluation of alarms: matching against known change points, alignment with events (Route A), segments (Route B).

Bars are (series_id, t, ts[, y]), alarms and truth (series_id, t), t from 1. Undefined ratios are NaN.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import nan, ratio
from .clean import SERIES


def match_events(truth: DataFrame, alarms: DataFrame, window: int = 10) -> DataFrame:
    """(series_id, tau, alarm, delay): each change point in order takes the first unused alarm in [tau, tau + window); alarm and delay are null for missed ones."""
    if window < 1:
        raise ValueError("a window has at least one step")

    def body(t: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        taus = sorted(set(t["t"].tolist())) if len(t) else []  # a side without rows may come without columns
        got = dict(K.match_events(taus, a["a"].tolist() if len(a) else [], window))
        alarm = pd.Series([got.get(x) for x in taus], dtype="Int64")
        return pd.DataFrame({SERIES: pd.Series([t[SERIES].iloc[0]] * len(taus) if len(taus) else [], dtype=object), "tau": pd.Series(taus, dtype="int64"), "alarm": alarm, "delay": alarm - pd.Series(taus, dtype="Int64")})

    return truth.select(SERIES, "t").groupBy(SERIES).cogroup(alarms.select(F.concat(SERIES, F.lit("")).alias(SERIES), (F.col("t") + 0).alias("a")).groupBy(SERIES)).applyInPandas(body, f"{SERIES} string, tau bigint, alarm bigint, delay bigint")


def metric_suite(matches: DataFrame, alarms: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series_id, n_events, n_alarms, true_positives, false_positives, detected, missed, precision, recall, miss_rate, false_alarm_rate, delay_mean, delay_median)."""
    m = matches.groupBy(SERIES).agg(F.count("*").alias("n_events"), F.count("alarm").alias("true_positives"), F.avg("delay").alias("delay_mean"), F.percentile("delay", F.lit(0.5)).alias("delay_median"))
    a = alarms.select(SERIES, "t").distinct().groupBy(SERIES).agg(F.count("*").alias("n_alarms"))
    rows = lengths.select(SERIES, "n").join(m, SERIES, "left").join(a, SERIES, "left").fillna(0, ["n_events", "true_positives", "n_alarms"])
    tp, events, found = F.col("true_positives"), F.col("n_events"), F.col("n_alarms")
    return rows.select(
        SERIES, "n_events", "n_alarms", "true_positives", (found - tp).alias("false_positives"), tp.alias("detected"), (events - tp).alias("missed"),
        ratio(tp, found, nan()).alias("precision"), ratio(tp, events, nan()).alias("recall"), ratio(events - tp, events, nan()).alias("miss_rate"),
        ratio(found - tp, F.col("n"), nan()).alias("false_alarm_rate"), F.coalesce("delay_mean", nan()).alias("delay_mean"), F.coalesce("delay_median", nan()).alias("delay_median"),
    )


def as_of(points: DataFrame, bars: DataFrame, forward: bool = True) -> DataFrame:
    """points (series_id, at, ...) with `index`: the t of the first bar at or after `at`, or of the last one at or before it; null if there is none.

    Points and bars are sorted together once, and the frame grows from the sort's start in both directions, so the cost after the sort is linear
    in both, however many points there are."""
    both = points.withColumns({"__at": F.col("at"), "__t": F.lit(None).cast("long")}).unionByName(bars.select(SERIES, F.col("ts").alias("__at"), F.col("t").cast("long").alias("__t")), allowMissingColumns=True)
    # Looking forward, time runs down. A bar comes before a point at its timestamp, and of several bars there the one last that is nearest in t.
    order = (F.desc("__at"), F.desc_nulls_last("__t")) if forward else (F.asc("__at"), F.asc_nulls_last("__t"))
    w = Window.partitionBy(SERIES).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("index", F.last("__t", ignorenulls=True).over(w)).where("__t IS NULL").drop("__at", "__t")


def event_windows(events: DataFrame, bars: DataFrame, pre: int = 3, post: int = 3, causal: bool = False) -> DataFrame:
    """Events (series_id, id, kind 'point' or 'window', start, end) with left, right and reference, as t; null where the series has no such bar.

    A point stands at the first bar at or after it and reaches from pre bars before (none if causal) to post behind, within the series;
    a window reaches from the first bar in it to the last bar at or before its end. Both ends are looked up in one sort of the bars, as as_of() does."""
    ends = F.array(F.struct(F.lit(True).alias("head"), F.col("start").alias("at")), F.struct(F.lit(False).alias("head"), F.coalesce("end", "start").alias("at")))
    numbered = events.select(SERIES, "id", "kind", "start", "end", F.monotonically_increasing_id().alias("__e"))
    marks = numbered.select(SERIES, "id", "kind", "__e", F.explode(ends).alias("m")).select(SERIES, "id", "kind", "__e", "m.head", F.col("m.at").alias("at"))
    both = marks.withColumn("__t", F.lit(None).cast("long")).unionByName(bars.select(SERIES, F.col("ts").alias("at"), F.col("t").cast("long").alias("__t")), allowMissingColumns=True)
    part = Window.partitionBy(SERIES)
    look = lambda *order: F.last("__t", ignorenulls=True).over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"f": look(F.desc("at"), F.desc_nulls_last("__t")), "l": look(F.asc("at"), F.asc_nulls_last("__t")), "n": F.max("__t").over(part)}).where("__e IS NOT NULL")
    rows = found.groupBy(SERIES, "__e").agg(F.first("id").alias("id"), F.first("kind").alias("kind"), F.first("n").alias("n"), F.max(F.when(F.col("head"), F.col("f"))).alias("first"), F.max(F.when(~F.col("head"), F.col("l"))).alias("last"))
    point = F.col("kind") == "point"
    left = F.when(point, F.greatest(F.col("first") - (0 if causal else pre), F.lit(1))).otherwise(F.col("first"))
    right = F.when(point, F.least(F.col("first") + post, F.col("n"))).otherwise(F.col("last"))
    ok = F.col("first").isNotNull() & right.isNotNull()
    return rows.select(SERIES, "id", F.when(ok, left).alias("left"), F.when(ok, right).alias("right"), F.when(ok, F.col("first")).alias("reference"))


def align(windows: DataFrame, alarms: DataFrame) -> DataFrame:
    """(series_id, id, n_matched, first_alarm, first_delay): alarms inside each event's window, of the same series.

    The number is a difference of running counts at the window's ends and the first one a lookup from its left end, so windows and alarms are
    sorted together and never paired."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("at")), F.struct(F.lit(2).alias("side"), F.col("right").alias("at")))
    numbered = windows.select(SERIES, "id", "reference", "left", "right", F.monotonically_increasing_id().alias("__w"))
    marks = numbered.select(SERIES, "id", "reference", "__w", F.explode(ends).alias("m")).select(SERIES, "id", "reference", "__w", "m.side", "m.at")
    both = marks.unionByName(alarms.select(SERIES, F.col("t").alias("at"), F.lit(1).alias("side")).distinct(), allowMissingColumns=True)
    part, frame = Window.partitionBy(SERIES), (Window.unboundedPreceding, 0)
    alarm = F.when(F.col("side") == 1, F.col("at"))
    rows = both.withColumns({"up_to": F.count(alarm).over(part.orderBy("at", "side").rowsBetween(*frame)), "next": F.last(alarm, ignorenulls=True).over(part.orderBy(F.desc("at"), F.desc("side")).rowsBetween(*frame))}).where("__w IS NOT NULL")
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    out = rows.groupBy(SERIES, "__w").agg(F.first("id").alias("id"), F.first("reference").alias("reference"), (at(2, "up_to") - at(0, "up_to")).alias("n"), at(0, "next").alias("next"), F.count("at").alias("ends"))
    matched = F.when(F.col("ends") == 2, F.greatest(F.col("n"), F.lit(0))).otherwise(0).cast("long")
    first = F.when(matched > 0, F.col("next"))
    return out.select(SERIES, "id", matched.alias("n_matched"), first.alias("first_alarm"), (first - F.col("reference")).alias("first_delay"))


def covered(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (series_id, t, ...) with `inside`: whether t is in any of the windows. One sweep over rows and the windows' ends counts the open ones."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("at"), F.lit(1).alias("d")), F.struct(F.lit(2).alias("side"), F.col("right").alias("at"), F.lit(-1).alias("d")))
    marks = windows.where("left IS NOT NULL AND left <= right").select(SERIES, F.explode(ends).alias("m")).select(SERIES, F.col("m.side").alias("__side"), F.col("m.at").alias("__at"), F.col("m.d").alias("__d"))
    both = rows.withColumns({"__side": F.lit(1), "__at": F.col("t"), "__d": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(SERIES).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("inside", F.sum("__d").over(w) > 0).where("__side = 1").drop("__side", "__at", "__d")


def in_windows(rows: DataFrame, windows: DataFrame, inside: bool = True) -> DataFrame:
    """Rows (series_id, t, ...) in, or outside, the union of the windows."""
    return covered(rows, windows).where(F.col("inside") == inside).drop("inside")


def route_a(bars: DataFrame, alarms: DataFrame, events: DataFrame, pre: int = 3, post: int = 3, causal: bool = False) -> DataFrame:
    """One row a series: n_events, n_alarms, n_events_covered, n_alarms_aligned, event_coverage, alarm_relevance, delays and densities in and outside windows."""
    windows = event_windows(events, bars, pre, post, causal)
    per = align(windows, alarms).groupBy(SERIES).agg(
        F.count("*").alias("n_events"), F.sum((F.col("n_matched") > 0).cast("long")).alias("n_events_covered"), F.avg("first_delay").alias("mean_delay_bars"),
        F.percentile("first_delay", F.lit(0.5)).alias("median_delay_bars"), F.min("first_delay").alias("min_delay_bars"), F.max("first_delay").alias("max_delay_bars"),
    )
    marks = bars.select(SERIES, "t").join(alarms.select(SERIES, "t").distinct().withColumn("alarm", F.lit(True)), [SERIES, "t"], "left")  # alarms off the bars don't count
    count = lambda c: F.count(F.when(c, 1))
    inside, alarm = F.col("inside"), F.col("alarm").isNotNull()
    rows = covered(marks, windows).groupBy(SERIES).agg(F.count("*").alias("n"), count(alarm).alias("n_alarms"), count(inside).alias("in_bars"), count(inside & alarm).alias("n_alarms_aligned"))
    rows = rows.join(per, SERIES, "left").fillna(0, ["n_events", "n_events_covered"])
    return rows.select(
        SERIES, "n_events", "n_alarms", "n_events_covered", "n_alarms_aligned",
        ratio("n_events_covered", "n_events", nan()).alias("event_coverage"), ratio("n_alarms_aligned", "n_alarms", nan()).alias("alarm_relevance"),
        F.coalesce("mean_delay_bars", nan()).alias("mean_delay_bars"), F.coalesce("median_delay_bars", nan()).alias("median_delay_bars"), "min_delay_bars", "max_delay_bars",
        ratio("n_alarms_aligned", "in_bars", nan()).alias("alarm_density_in"), ratio(F.col("n_alarms") - F.col("n_alarms_aligned"), F.col("n") - F.col("in_bars"), nan()).alias("alarm_density_out"),
    )


def segments(bars: DataFrame, alarms: DataFrame) -> DataFrame:
    """bars with segment_index from 0: a segment starts at the first bar and at each alarm behind it."""
    marks = alarms.where("t > 1").select(SERIES, "t").distinct().withColumn("__m", F.lit(1))
    w = Window.partitionBy(SERIES).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.join(marks, [SERIES, "t"], "left")
    return rows.withColumn("segment_index", F.coalesce(F.sum("__m").over(w), F.lit(0)).cast("long")).drop("__m")


def lag1(keys: list[str], rows: DataFrame, value: str = "y", undefined: Column | None = None) -> DataFrame:
    """(keys, acf1): lag-1 autocorrelation about the group's mean; 0 without variance, `undefined` for fewer than two rows."""
    w = Window.partitionBy(*keys)
    d = rows.select(*keys, "t", (F.col(value) - F.avg(value).over(w)).alias("d"))
    d = d.withColumn("next", F.lead("d").over(w.orderBy("t")))
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("next")).alias("num"), F.sum(F.col("d") * F.col("d")).alias("den"))
    return out.select(*keys, F.when(F.col("n") < 2, nan() if undefined is None else undefined).when(F.col("den") == 0, F.lit(0.0)).otherwise(ratio("num", "den")).alias("acf1"))


def segment_summary(rows: DataFrame, min_len: int = 5) -> DataFrame:
    """Per segment: start, end, n, mean, variance, std_dev, mean_abs, q05, q50, q95, acf1, is_short."""
    keys = [SERIES, "segment_index"]
    q = F.percentile("y", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = rows.groupBy(*keys).agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("variance"), F.stddev_pop("y").alias("std_dev"),
        F.avg(F.abs("y")).alias("mean_abs"), q.alias("q"),
    )
    out = out.join(lag1(keys, rows), keys)
    return out.select(*keys, "start", "end", "n", "mean", "variance", "std_dev", "mean_abs", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"), "acf1", (F.col("n") < min_len).alias("is_short"))


def adjacent_contrasts(summary: DataFrame) -> DataFrame:
    """(series_id, segment_index, delta_mean, delta_variance, delta_mean_abs, effect_size) between a segment and the next one."""
    w = Window.partitionBy(SERIES).orderBy("segment_index")
    nxt = {c: F.lead(c).over(w) for c in ("mean", "variance", "mean_abs")}
    rows = summary.select(SERIES, "segment_index", "mean", "variance", "mean_abs", *[v.alias(f"n_{c}") for c, v in nxt.items()]).where("n_mean IS NOT NULL")
    pooled = F.sqrt((F.col("variance") + F.col("n_variance")) / 2)
    delta = F.col("n_mean") - F.col("mean")
    return rows.select(SERIES, "segment_index", delta.alias("delta_mean"), (F.col("n_variance") - F.col("variance")).alias("delta_variance"), (F.col("n_mean_abs") - F.col("mean_abs")).alias("delta_mean_abs"), ratio(delta, pooled, 0.0).alias("effect_size"))


def segmentation_global(summary: DataFrame, contrasts: DataFrame, exclude_short: bool = False) -> DataFrame:
    """One row a series: segments, short ones, mean length, mean variance (without short ones if asked), mean absolute contrasts, coherence."""
    used = F.when(~F.col("is_short"), F.col("variance")) if exclude_short else F.col("variance")
    s = summary.groupBy(SERIES).agg(F.count("*").alias("n_segments"), F.sum(F.col("is_short").cast("long")).alias("n_short_segments"), F.avg("n").alias("mean_segment_len"), F.avg(used).alias("v"))
    c = contrasts.groupBy(SERIES).agg(F.avg(F.abs("delta_mean")).alias("dm"), F.avg(F.abs("delta_variance")).alias("dv"))
    rows = s.join(c, SERIES, "left")
    coherence = F.when((F.col("v") > 0) & F.col("dm").isNotNull(), F.col("dm") / F.sqrt(F.when(F.col("v") > 0, F.col("v")))).otherwise(nan())
    return rows.select(SERIES, "n_segments", "n_short_segments", "mean_segment_len", F.coalesce("v", nan()).alias("mean_within_variance"), F.coalesce("dm", nan()).alias("mean_abs_delta_mean"), F.coalesce("dv", nan()).alias("mean_abs_delta_variance"), coherence.alias("coherence"))


def route_b(bars: DataFrame, alarms: DataFrame, min_len: int = 5, exclude_short: bool = False) -> DataFrame:
    lengths = bars.groupBy(SERIES).agg(F.count("*").alias("n"))
    good = alarms.join(lengths, SERIES).where("t BETWEEN 1 AND n").select(SERIES, "t").distinct()
    s = segment_summary(segments(bars, good), min_len)
    return segmentation_global(s, adjacent_contrasts(s), exclude_short)


def real_evaluation(bars: DataFrame, alarms: DataFrame, events: DataFrame, pre: int = 3, post: int = 3, causal: bool = False, min_len: int = 5) -> DataFrame:
    """Route A and Route B side by side, one row a series, with the score that ranks real runs."""
    rows = route_a(bars, alarms, events, pre, post, causal).join(route_b(bars, alarms, min_len), SERIES)
    return rows.withColumn("score", (F.col("event_coverage") + F.col("alarm_relevance") + F.col("coherence")) / 3)


def comparison_table(runs: list[DataFrame]) -> DataFrame:
    """Summaries of several runs as one table; columns that a run lacks are null."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def sim_real_gap(sim: DataFrame, real: DataFrame, metrics: list[str]) -> DataFrame:
    """(series_id, metric, sim, real, gap = real - sim)."""
    both = sim.select(SERIES, *[F.col(m).alias(f"s_{m}") for m in metrics]).join(real.select(SERIES, *[F.col(m).alias(f"r_{m}") for m in metrics]), SERIES)
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"s_{m}").cast("double").alias("sim"), F.col(f"r_{m}").cast("double").alias("real"), (F.col(f"r_{m}") - F.col(f"s_{m}")).cast("double").alias("gap")) for m in metrics]
    return both.select(SERIES, F.explode(F.array(*cells)).alias("c")).select(SERIES, "c.*")
