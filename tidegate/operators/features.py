"""Causal features of cleaned series: returns, rolling volatility, standardised returns, and scalers fitted on the train prefix.

Every feature keeps the timestamp of its current row. Rows whose return is undefined are dropped after the lag, so they still
are the previous row of the next one. Session-aware features also partition by calendar date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_return
from .clean import SERIES

FAMILIES = ("log_return", "abs_return", "squared_return", "rolling_vol", "standardized_return")
SCALINGS = ("none", "zscore", "robust_zscore")


@dataclass(frozen=True)
class Feature:
    """family, window (of rolling families), whether sessions part the series, the scaling and the guard of standardised returns."""

    family: str = "log_return"
    window: int = 5
    session_aware: bool = False
    scaling: str = "zscore"
    epsilon: float = 1e-8

    def check(self) -> Feature:
        if self.family not in FAMILIES or self.scaling not in SCALINGS:
            raise ValueError(f"no feature {self.family!r} with scaling {self.scaling!r}")
        if self.rolling and self.window < 2:
            raise ValueError("a rolling window has at least two returns")
        if not self.epsilon > 0:
            raise ValueError("epsilon must be above zero")
        return self

    @property
    def rolling(self) -> bool:
        return self.family in ("rolling_vol", "standardized_return")

    @property
    def warmup(self) -> int:
        """Rows that a series loses at its start."""
        return self.window if self.rolling else 1

    def label(self, symbol: str) -> str:
        tail = f"_w{self.window}" if self.rolling else ""
        return f"{symbol}_{self.family}{tail}_sr{int(self.session_aware)}"


def _keys(session_aware: bool) -> list[Column]:
    return [F.col(SERIES), *([F.to_date("ts")] if session_aware else [])]


def returns(df: DataFrame, family: str = "log_return", session_aware: bool = False) -> DataFrame:
    """(series_id, ts, y): log, absolute or squared returns of consecutive rows."""
    before = F.lag("value").over(Window.partitionBy(*_keys(session_aware)).orderBy("ts"))
    r = log_return(F.col("__before"), F.col("value"))
    y = {"log_return": r, "abs_return": F.abs(r), "squared_return": r * r}[family]
    return df.withColumn("__before", before).select(SERIES, "ts", y.alias("y")).where("y IS NOT NULL")


def rolling(df: DataFrame, family: str, window: int, session_aware: bool = False, epsilon: float = 1e-8) -> DataFrame:
    """(series_id, ts, y): population standard deviation of the last `window` returns, or the return over it; only where the window is full."""
    r = returns(df, "log_return", session_aware)
    w = Window.partitionBy(*_keys(session_aware)).orderBy("ts").rowsBetween(-(window - 1), 0)
    full = r.select(SERIES, "ts", F.col("y").alias("r"), F.count("y").over(w).alias("n"), F.stddev_pop("y").over(w).alias("vol"))
    y = F.col("vol") if family == "rolling_vol" else F.col("r") / (F.col("vol") + F.lit(epsilon))
    return full.where(F.col("n") == window).select(SERIES, "ts", y.alias("y"))


def rolling_mean(df: DataFrame, window: int, session_aware: bool = False) -> DataFrame:
    """(series_id, ts, y): mean of the last `window` returns, where the window is full."""
    r = returns(df, "log_return", session_aware)
    w = Window.partitionBy(*_keys(session_aware)).orderBy("ts").rowsBetween(-(window - 1), 0)
    return r.select(SERIES, "ts", F.count("y").over(w).alias("n"), F.avg("y").over(w).alias("y")).where(F.col("n") == window).select(SERIES, "ts", "y")


def raw(df: DataFrame, f: Feature) -> DataFrame:
    f.check()
    return rolling(df, f.family, f.window, f.session_aware, f.epsilon) if f.rolling else returns(df, f.family, f.session_aware)


def numbered(features: DataFrame) -> DataFrame:
    """Adds t, from 1 in each series."""
    return features.withColumn("t", F.row_number().over(Window.partitionBy(SERIES).orderBy("ts")).cast("long"))


def fit_scaler(features: DataFrame, scaling: str, floor: float | None = None) -> DataFrame:
    """(series_id, location, scale) of rows (series_id, y): mean and population deviation, or median and interquartile
    range; a scale of zero counts as one (or is held at a floor)."""
    if scaling == "none":
        return features.groupBy(SERIES).agg(F.lit(0.0).alias("location"), F.lit(1.0).alias("scale"))
    if scaling == "zscore":
        out = features.groupBy(SERIES).agg(F.avg("y").alias("location"), F.stddev_pop("y").alias("scale"))
    else:
        q = features.groupBy(SERIES).agg(F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
        out = q.select(SERIES, F.col("q")[1].alias("location"), (F.col("q")[2] - F.col("q")[0]).alias("scale"))
    scale = F.greatest("scale", F.lit(floor)) if floor else F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale"))
    return out.withColumn("scale", scale)


def apply_scaler(features: DataFrame, scaler: DataFrame) -> DataFrame:
    """(y - location) / scale on all rows; a series without scaler keeps its values."""
    y = (F.col("y") - F.coalesce("location", F.lit(0.0))) / F.coalesce("scale", F.lit(1.0))
    return features.join(scaler.select(SERIES, "location", "scale"), SERIES, "left").withColumn("y", y).drop("location", "scale")


def train_rows(df: DataFrame, share: float = 0.70) -> DataFrame:
    """(series_id, n_train): price rows before the train cut."""
    return df.groupBy(SERIES).agg(F.floor(F.lit(share) * F.count("*")).cast("long").alias("n_train"))


def stream(df: DataFrame, f: Feature, share: float = 0.70, strict: bool = False) -> DataFrame:
    """(series_id, t, ts, y): features scaled by the train prefix.

    The prefix is counted in price rows but applied to feature rows, so `warmup` rows behind the
    cut enter the scaler; strict leaves them out."""
    features = numbered(raw(df, f))
    n = train_rows(df, share)
    last = F.greatest(F.col("n_train") - (f.warmup if strict else 0), F.lit(0))
    prefix = features.join(n, SERIES).where(F.col("t") <= last)
    return apply_scaler(features, fit_scaler(prefix, f.scaling)).select(SERIES, "t", "ts", "y")


def summary(features: DataFrame) -> DataFrame:
    """(series_id, n, mean, variance, min, max)."""
    return features.groupBy(SERIES).agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("variance"), F.min("y").alias("min"), F.max("y").alias("max"))
