"""Cleaning: order, duplicates, gaps, sessions, date ranges and chronological splits of (series_id, ts, value) rows.

Windows are partitioned by series; the column `ord` gives the order of arrival where that matters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = "series_id"
RTH_OPEN, RTH_CLOSE = "09:30:00", "16:00:00"
FAR = dt.datetime(9999, 12, 31)


def by_time(*also: str) -> Window:
    return Window.partitionBy(SERIES).orderBy("ts", *also)


def keep_first(df: DataFrame) -> DataFrame:
    """Of rows with one series and timestamp, the one that came first."""
    w = Window.partitionBy(SERIES, "ts").orderBy("ord")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def gaps(df: DataFrame, bar_minutes: int) -> DataFrame:
    """(series_id, gap_from, gap_to): neighbours of a series more than three bars apart."""
    before = F.lag("ts").over(by_time())
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(3 * bar_minutes), F.lit(0))
    return df.withColumn("gap_from", before).where(F.col("ts") - F.col("gap_from") > limit).select(SERIES, "gap_from", F.col("ts").alias("gap_to"))


def quality_report(df: DataFrame, bar_minutes: int | None = None) -> DataFrame:
    """(series_id, n_input, n_dropped_duplicates, n_output, had_unsorted_input, n_gaps); daily series (bar_minutes None) have no gaps."""
    arrival = Window.partitionBy(SERIES).orderBy("ord")
    rows = df.withColumn("__back", F.coalesce(F.lag("ts").over(arrival) > F.col("ts"), F.lit(False)))
    out = rows.groupBy(SERIES).agg(F.count("*").alias("n_input"), F.countDistinct("ts").alias("n_output"), F.max("__back").alias("had_unsorted_input"))
    out = out.withColumn("n_dropped_duplicates", F.col("n_input") - F.col("n_output"))
    if bar_minutes is None:
        return out.withColumn("n_gaps", F.lit(0).cast("long"))
    found = gaps(df.select(SERIES, "ts").distinct(), bar_minutes).groupBy(SERIES).agg(F.count("*").alias("n_gaps"))
    return out.join(found, SERIES, "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0).cast("long")))


def clean(df: DataFrame) -> DataFrame:
    """Rows of finite value, one for each timestamp; gaps stay gaps."""
    return keep_first(df)


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both days included, the last one to 23:59:59. Filters the scan, so use it before anything with a window."""
    if start:
        df = df.where(F.col("ts") >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz"))
    if end:
        df = df.where(F.col("ts") <= F.lit(f"{end} 23:59:59").cast("timestamp_ntz"))
    return df


def time_of_day(ts: Column | str = "ts") -> Column:
    return F.date_format(ts, "HH:mm:ss")


def regular_hours(df: DataFrame) -> DataFrame:
    """Bars that open from 09:30:00 up to, but not at, 16:00:00."""
    return df.where((time_of_day() >= RTH_OPEN) & (time_of_day() < RTH_CLOSE))


def sessions(df: DataFrame) -> DataFrame:
    """(series_id, session_index from 0, date, first_obs_idx, last_obs_idx): runs of one calendar date, with 0-based row numbers."""
    rows = df.select(SERIES, F.to_date("ts").alias("date"), (F.row_number().over(by_time()) - 1).cast("long").alias("i"))
    out = rows.groupBy(SERIES, "date").agg(F.min("i").alias("first_obs_idx"), F.max("i").alias("last_obs_idx"))
    index = (F.row_number().over(Window.partitionBy(SERIES).orderBy("date")) - 1).cast("long")
    return out.select(SERIES, index.alias("session_index"), "date", "first_obs_idx", "last_obs_idx")


def session_rows(df: DataFrame, index: int) -> DataFrame:
    """The rows of one session."""
    day = F.dense_rank().over(Window.partitionBy(SERIES).orderBy(F.to_date("ts"))) - 1
    return df.withColumn("__s", day).where(F.col("__s") == index).drop("__s")


def cut_points(df: DataFrame, train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """(series_id, n, train_end, val_end): timestamps of the rows numbered floor(share * n); beyond the last row, the far future."""
    rows = df.select(SERIES, "ts", (F.row_number().over(by_time()) - 1).alias("i"), F.count("*").over(Window.partitionBy(SERIES)).alias("n"))
    at = lambda share: F.coalesce(F.max(F.when(F.col("i") == F.floor(F.lit(share) * F.col("n")), F.col("ts"))), F.lit(FAR).cast("timestamp_ntz"))
    return rows.groupBy(SERIES).agg(F.max("n").alias("n"), at(train).alias("train_end"), at(validation).alias("val_end"))


def split(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds partition: train before train_end, validation before val_end, test from there."""
    part = F.when(F.col("ts") < F.col("train_end"), "train").when(F.col("ts") < F.col("val_end"), "validation").otherwise("test")
    return df.join(cuts.select(SERIES, "train_end", "val_end"), SERIES).withColumn("partition", part).drop("train_end", "val_end")


def finite_rows(df: DataFrame, column: str = "value") -> DataFrame:
    from ..functions.columns import finite

    return df.where(finite(column))


def alarm_times(alarms: DataFrame, lengths: DataFrame) -> DataFrame:
    """Distinct alarms (series_id, t) within 1..n of their series."""
    return alarms.join(lengths.select(SERIES, "n"), SERIES).where("t BETWEEN 1 AND n").select(SERIES, "t").distinct()


def daily_timestamps(df: DataFrame, start: str = "2000-01-01") -> DataFrame:
    """Timestamps for rows that only have t: one day each from a start."""
    return df.withColumn("ts", F.date_add(F.lit(start).cast("date"), (F.col("t") - 1).cast("int")).cast("timestamp_ntz"))


def invalid_truth(truth: DataFrame, lengths: DataFrame) -> DataFrame:
    """Change points that are outside 1..n or repeated; empty if the truth is valid."""
    counted = truth.groupBy(SERIES, "t").agg(F.count("*").alias("times")).join(lengths.select(SERIES, "n"), SERIES, "left")
    return counted.where("n IS NULL OR t < 1 OR t > n OR times > 1")


def invalid_events(events: DataFrame) -> DataFrame:
    """Proxy events without id or type, or whose window ends before it starts."""
    return events.where("trim(coalesce(id, '')) = '' OR trim(coalesce(event_type, '')) = '' OR start > end")
