"""Column expressions that stay inside Catalyst; every zero divisor and logarithm is guarded, as ANSI mode raises on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import HALF_LN_2PI

def nan() -> Column:
    return F.lit(float("nan"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_return(prev: Column | str, curr: Column | str) -> Column:
    """ln(curr) - ln(prev); null unless both are above zero."""
    p, c = col(prev), col(curr)
    return F.when((p > 0) & (c > 0), F.log(c) - F.log(p))


def ratio(a: Column | str, b: Column | str, otherwise: Column | float | None = None) -> Column:
    """a / b, or otherwise (null by default) where b is zero."""
    x = F.when(col(b) != 0, col(a) / F.when(col(b) != 0, col(b)))
    return x if otherwise is None else F.when(col(b) != 0, x).otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def finite(c: Column | str) -> Column:
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def log_density(y: Column | str, mean: Column | float, variance: Column | float) -> Column:
    """Gaussian log density."""
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    v = variance if isinstance(variance, Column) else F.lit(float(variance))
    return -F.lit(HALF_LN_2PI) - F.lit(0.5) * F.log(v) - F.lit(0.5) * (col(y) - m) * (col(y) - m) / v


def log_sum_exp(xs: Column) -> Column:
    """Of an array; minus infinity if every element is."""
    top = F.array_max(xs)
    return F.when(top == F.lit(float("-inf")), top).otherwise(top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def dominant(probabilities: Column | str) -> Column:
    """0-based index of the largest element, the last one of a tie."""
    pairs = F.transform(col(probabilities), lambda x, i: F.named_struct(F.lit("x"), x, F.lit("i"), i))
    return F.array_max(pairs)["i"]


def total_variation(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2


def parse_timestamp(text: Column | str) -> Column:
    """`Y-m-d H:M:S`, `Y-m-d` or `Y-m` as a timestamp without zone; null for anything else."""
    t = F.trim(col(text))
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), t)
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit(" 00:00:00")))
    month = F.when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01 00:00:00")))
    return F.coalesce(full, day, month).try_cast("timestamp_ntz")


def sanitize_name(text: Column | str) -> Column:
    """A name fit for a folder: other characters become `_`, runs of it one, none at the ends."""
    x = F.regexp_replace(col(text), "[^A-Za-z0-9_-]", "_")
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", "")
