"""A query for each operator over the driver's tables, and the SQL that says the same.

events give intraday series (one a type), orders daily ones (the largest order of a day, one series a priority) and, with the order
key as order of arrival, raw series with duplicates.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import kernels as K
from .operators import calibrate, clean, detect, evaluate, features, hmm, scan, search
from .operators.clean import SERIES
from .sources import store, vendor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A fitted model of two regimes.
MODEL = K.Params([0.0, 1.0], [[0.9466, 0.0534], [0.1971, 0.8029]], [-0.038, 0.140], [0.655, 2.243])
PI, TR, MU, VA = MODEL.pi.tolist(), MODEL.transition.tolist(), MODEL.means.tolist(), MODEL.variances.tolist()
DET = K.Detector("hard_switch", 0.5, 2, 5)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias(SERIES), F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias(SERIES), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderkey").cast("long").alias("ord"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_orders(spark, sf_dir).groupBy(SERIES, "ts").agg(F.max("value").alias("value"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scored log returns of the intraday series."""
    return features.stream(intraday(spark, sf_dir), features.Feature())


def model_rows(spark: SparkSession, sf_dir: str, move_first: bool = True) -> DataFrame:
    return hmm.filter_rows(obs(spark, sf_dir), MODEL, move_first)


def numbered_bars(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.row_number().over(Window.partitionBy(SERIES).orderBy("ts")).cast("long"))


def neat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null and no negative zero; counts as bigint."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(c)
        if kind == "double":
            r = F.round(x, digits)
            x = F.when(F.isnan(x), F.lit(None)).when(r == 0, F.lit(0.0)).otherwise(r)
        elif kind == "int":
            x = x.cast("long")
        out.append(x.alias(c))
    return df.select(*out)


def R(x: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"CASE WHEN isnan(CAST({x} AS DOUBLE)) THEN NULL WHEN round({x}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round(CAST({x} AS DOUBLE), {digits}) END"


# --- SQL of the series -------------------------------------------------------------------------

INTRADAY = "SELECT event_type AS series_id, ts, value FROM events"
RAW = "SELECT o_orderpriority AS series_id, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_totalprice AS DOUBLE) AS value, o_orderkey AS ord FROM orders"
DAILY = "SELECT o_orderpriority AS series_id, CAST(o_orderdate AS TIMESTAMP) AS ts, max(CAST(o_totalprice AS DOUBLE)) AS value FROM orders GROUP BY ALL"
W = "(PARTITION BY series_id ORDER BY ts)"
WT = "(PARTITION BY series_id ORDER BY t)"


def returns_sql(source: str, session: bool = False, name: str = "ret") -> str:
    part = "series_id, CAST(ts AS DATE)" if session else "series_id"
    return f"""src AS ({source}),
{name} AS (SELECT series_id, ts, r FROM (SELECT series_id, ts, CASE WHEN p > 0 AND value > 0 THEN ln(value) - ln(p) END AS r FROM
  (SELECT *, lag(value) OVER (PARTITION BY {part} ORDER BY ts) AS p FROM src)) WHERE r IS NOT NULL)"""


OBS = (
    returns_sql(INTRADAY)
    + f""",
feat AS (SELECT series_id, ts, r, row_number() OVER {W} AS t FROM ret),
ntr AS (SELECT series_id, floor(0.7::DOUBLE * count(*)) AS n FROM src GROUP BY 1),
sc AS (SELECT series_id, avg(r) AS loc, stddev_pop(r) AS sc FROM feat JOIN ntr USING (series_id) WHERE t <= n GROUP BY 1),
obs AS (SELECT series_id, t, ts, (r - loc) / CASE WHEN sc = 0 THEN 1 ELSE sc END AS y FROM feat JOIN sc USING (series_id))"""
)


def density_sql(y: str, j: int) -> str:
    return f"(exp(-0.5 * ({y} - ({MU[j]})) * ({y} - ({MU[j]})) / {VA[j]}) / sqrt({VA[j]}))"


def filter_sql(move_first: bool) -> str:
    start = (MODEL.pi @ MODEL.transition).tolist() if move_first else PI
    step = "SELECT series_id, t, ts, y, q0, q1, q0 * d0 / (q0 * d0 + q1 * d1) AS f0, q1 * d1 / (q0 * d0 + q1 * d1) AS f1, ln(q0 * d0 + q1 * d1) - 0.9189385332046728 AS log_c FROM"
    den = f"{density_sql('o.y', 0)} AS d0, {density_sql('o.y', 1)} AS d1"
    return f"""flt AS (
  {step} (SELECT o.series_id, o.t, o.ts, o.y, {start[0]!r}::DOUBLE AS q0, {start[1]!r}::DOUBLE AS q1, {den} FROM obs o WHERE o.t = 1)
  UNION ALL
  {step} (SELECT o.series_id, o.t, o.ts, o.y, f.f0 * {TR[0][0]} + f.f1 * {TR[1][0]} AS q0, f.f0 * {TR[0][1]} + f.f1 * {TR[1][1]} AS q1, {den}
    FROM flt f JOIN obs o ON o.series_id = f.series_id AND o.t = f.t + 1))"""


ONLINE = f"WITH RECURSIVE {OBS},\n{filter_sql(True)}"
OFFLINE = f"WITH RECURSIVE {OBS},\n{filter_sql(False)}"
SMOOTH = (
    OFFLINE
    + f""",
nxt AS (SELECT *, lead(q0) OVER {WT} AS n0, lead(q1) OVER {WT} AS n1, lag(f0) OVER {WT} AS b0, lag(f1) OVER {WT} AS b1, count(*) OVER (PARTITION BY series_id) AS n FROM flt),
smo AS (
  SELECT series_id, t, f0 AS g0, f1 AS g1 FROM nxt WHERE t = n
  UNION ALL
  SELECT series_id, t, u0 / (u0 + u1), u1 / (u0 + u1) FROM (
    SELECT x.series_id, x.t, x.f0 * ({TR[0][0]} * s.g0 / x.n0 + {TR[0][1]} * s.g1 / x.n1) AS u0, x.f1 * ({TR[1][0]} * s.g0 / x.n0 + {TR[1][1]} * s.g1 / x.n1) AS u1
    FROM smo s JOIN nxt x ON x.series_id = s.series_id AND x.t = s.t - 1)),
sm AS (SELECT nxt.*, g0, g1 FROM nxt JOIN smo USING (series_id, t)),
xi AS (SELECT series_id, t, {", ".join(f"b{i} * {TR[i][j]} * g{j} / q{j} AS x{i}{j}" for i in range(2) for j in range(2))} FROM sm WHERE t > 1)"""
)
TOP = "CASE WHEN f1 >= f0 THEN 1 ELSE 0 END"
DETECT = (
    ONLINE
    + f""",
top AS (SELECT *, {TOP} AS top, lag({TOP}) OVER {WT} AS top_before, lag(f0) OVER {WT} AS p0, lag(f1) OVER {WT} AS p1 FROM flt)"""
)
SCORES = {
    "hard_switch": "CASE WHEN top <> top_before AND greatest(f0, f1) >= 0.5 THEN 1.0 ELSE 0.0 END",
    "leave_previous": "CASE WHEN top_before = 1 THEN 1 - f1 ELSE 1 - f0 END",
    "total_variation": "(abs(f0 - p0) + abs(f1 - p1)) / 2",
    "surprise": "-log_c",
}


def scored_sql(kind: str) -> str:
    ready = "true" if kind == "surprise" else "t > 1"
    return f"{DETECT}, scored AS (SELECT series_id, t, ts, CASE WHEN {ready} THEN {SCORES[kind]} ELSE 0.0 END AS score, {ready} AS ready, top, top_before FROM top)"


def persist_sql(crossed: str, required: int, cooldown: int, source: str) -> str:
    """States (c, left) of the persistence rule, step by step."""
    fires = f"(NOT waiting AND cr AND c + 1 >= {required})"
    return f"""steps AS (SELECT series_id, t, ready, ready AND ({crossed}) AS cr FROM {source}),
per AS (
  SELECT series_id, 0::BIGINT AS t, 0 AS c, 0 AS left_, false AS alarm FROM (SELECT DISTINCT series_id FROM steps)
  UNION ALL
  SELECT series_id, t, CASE WHEN NOT ready THEN c WHEN waiting OR NOT cr OR {fires} THEN 0 ELSE c + 1 END,
    CASE WHEN NOT ready THEN left_ WHEN waiting THEN left_ - 1 WHEN {fires} THEN {cooldown} ELSE 0 END, ready AND {fires}
  FROM (SELECT s.series_id, s.t, s.ready, s.cr, p.c, p.left_, p.left_ > 0 AS waiting FROM per p JOIN steps s ON s.series_id = p.series_id AND s.t = p.t + 1))"""


ALARMS = f"{scored_sql('hard_switch')}, {persist_sql('score > 0', 2, 5, 'scored')}"


# --- store -------------------------------------------------------------------------------------


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the store's price table: symbol is the priority, interval the status."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("interval"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").cast("double").alias("value"), F.expr("cast(o_orderdate as timestamp_ntz) + make_dt_interval(cast(o_orderkey % 30 as int))").alias("fetched_at"))


META_ROWS = [("1-URGENT", "O", "Urgent", "USD"), ("1-URGENT", "F", "Urgent filled", "USD"), ("2-HIGH", "O", "High", "EUR"), ("5-LOW", "P", "Low", None)]
META_SQL = "meta(symbol, \"interval\", name, unit) AS (VALUES ('1-URGENT', 'O', 'Urgent', 'USD'), ('1-URGENT', 'F', 'Urgent filled', 'USD'), ('2-HIGH', 'O', 'High', 'EUR'), ('5-LOW', 'P', 'Low', NULL))"
FACT_SQL = 'fact AS (SELECT o_orderpriority AS symbol, o_orderstatus AS "interval", CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_totalprice AS DOUBLE) AS value, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS fetched_at FROM orders)'


def meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(META_ROWS, "symbol string, interval string, name string, unit string")


@query("status_report", f'WITH {FACT_SQL}, {META_SQL} SELECT f.symbol, f."interval", coalesce(name, \'\') AS name, coalesce(unit, \'\') AS unit, count(*)::BIGINT AS n, min(ts) AS first_ts, max(ts) AS last_ts, max(fetched_at) AS fetched_at FROM fact f LEFT JOIN meta m ON m.symbol = f.symbol AND m."interval" = f."interval" GROUP BY ALL')
def status_report(spark, sf_dir):
    return store.status(fact(spark, sf_dir), meta(spark))


@query("load_series", f"WITH {FACT_SQL} SELECT ts, value FROM fact WHERE symbol = '1-URGENT' AND \"interval\" = 'F' ORDER BY ts DESC")
def load_series(spark, sf_dir):
    return store.load(fact(spark, sf_dir), meta(spark), "1-URGENT", "F")


@query("last_fetched", f"WITH {FACT_SQL} SELECT max(fetched_at) AS fetched_at FROM fact WHERE symbol = '2-HIGH' AND \"interval\" = 'O'")
def last_fetched(spark, sf_dir):
    return store.last_fetched(fact(spark, sf_dir), "2-HIGH", "O")


@query("show_newest", f"WITH {FACT_SQL} SELECT ts, value FROM (SELECT ts, max(value) AS value FROM fact WHERE symbol = '2-HIGH' AND \"interval\" = 'O' GROUP BY ts) ORDER BY ts DESC LIMIT 10")
def show_newest(spark, sf_dir):
    one = fact(spark, sf_dir).groupBy("symbol", "interval", "ts").agg(F.max("value").alias("value"))
    return store.newest(one, "2-HIGH", "O", 10)


@query("replace_series", f"WITH {FACT_SQL}, new AS (SELECT symbol, \"interval\", ts, value * 2 AS value, fetched_at FROM fact WHERE symbol IN ('3-MEDIUM', '5-LOW') AND \"interval\" = 'O') SELECT * FROM fact f WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.symbol = f.symbol AND n.\"interval\" = f.\"interval\") UNION ALL SELECT * FROM new")
def replace_series(spark, sf_dir):
    old = fact(spark, sf_dir)
    return store.replaced(old, old.where("symbol IN ('3-MEDIUM', '5-LOW') AND interval = 'O'").withColumn("value", F.col("value") * 2))


@query("missing_series", f'WITH {FACT_SQL}, {META_SQL} SELECT DISTINCT symbol, "interval" FROM fact f WHERE NOT EXISTS (SELECT 1 FROM meta m WHERE m.symbol = f.symbol AND m."interval" = f."interval")')
def missing_series(spark, sf_dir):
    return store.missing(fact(spark, sf_dir).select("symbol", "interval").distinct(), meta(spark))


WIRE = "to_json(named_struct('name', o_orderpriority, 'interval', 'daily', 'unit', 'USD', 'data', array(named_struct('date', date_format(o_orderdate, 'yyyy-MM-dd'), 'value', if(o_orderkey % 7 = 0, '.', cast(cast(o_totalprice as decimal(18,2)) as string))))))"


@query("decode_standard", "SELECT 'wti' AS symbol, 'daily' AS \"interval\", o_orderpriority AS name, 'USD' AS unit, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, round(CAST(o_totalprice AS DOUBLE), 2) AS value FROM orders WHERE o_orderkey % 7 <> 0")
def decode_standard(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.lit("wti").alias("symbol"), F.lit("daily").alias("interval"), F.expr(WIRE).alias("payload"))
    return vendor.decode_standard(rows).withColumn("value", F.round("value", 2))


# --- cleaning ----------------------------------------------------------------------------------


@query("dedup_keep_first", f"SELECT series_id, ts, value, ord FROM (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY ord) AS n FROM ({RAW})) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    return clean.keep_first(raw_orders(spark, sf_dir))


@query("dq_report", f"""WITH raw AS ({RAW}), o AS (SELECT *, lag(ts) OVER (PARTITION BY series_id ORDER BY ord) > ts AS back FROM raw), d AS (SELECT DISTINCT series_id, ts FROM raw),
g AS (SELECT series_id, count(*) FILTER (ts - p > INTERVAL 4320 MINUTE) AS n_gaps FROM (SELECT *, lag(ts) OVER {W} AS p FROM d) GROUP BY 1)
SELECT series_id, count(*)::BIGINT AS n_input, count(DISTINCT ts)::BIGINT AS n_output, coalesce(bool_or(back), false) AS had_unsorted_input, (count(*) - count(DISTINCT ts))::BIGINT AS n_dropped_duplicates, any_value(n_gaps)::BIGINT AS n_gaps FROM o JOIN g USING (series_id) GROUP BY 1""")
def dq_report(spark, sf_dir):
    return clean.quality_report(raw_orders(spark, sf_dir), 24 * 60)


@query("gap_report", f"SELECT series_id, p AS gap_from, ts AS gap_to FROM (SELECT *, lag(ts) OVER {W} AS p FROM ({INTRADAY})) WHERE ts - p > INTERVAL 180 MINUTE")
def gap_report(spark, sf_dir):
    return clean.gaps(intraday(spark, sf_dir), 60)


@query("date_range", f"SELECT * FROM ({INTRADAY}) WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 23:59:59'")
def date_range(spark, sf_dir):
    return clean.date_range(intraday(spark, sf_dir), "2024-01-05", "2024-01-20")


@query("rth_filter", f"SELECT * FROM ({INTRADAY}) WHERE CAST(ts AS TIME) >= TIME '09:30:00' AND CAST(ts AS TIME) < TIME '16:00:00'")
def rth_filter(spark, sf_dir):
    return clean.regular_hours(intraday(spark, sf_dir))


@query("sessions", f"WITH s AS (SELECT series_id, CAST(ts AS DATE) AS date, row_number() OVER {W} - 1 AS i FROM ({INTRADAY})) SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY date) - 1)::BIGINT AS session_index, date, min(i)::BIGINT AS first_obs_idx, max(i)::BIGINT AS last_obs_idx FROM s GROUP BY series_id, date")
def sessions(spark, sf_dir):
    return clean.sessions(intraday(spark, sf_dir))


@query("session_slice", f"SELECT series_id, ts, value FROM (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY CAST(ts AS DATE)) AS s FROM ({INTRADAY})) WHERE s = 4")
def session_slice(spark, sf_dir):
    return clean.session_rows(intraday(spark, sf_dir), 3)


CUTS = f"s AS ({DAILY}), n AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s), c AS (SELECT series_id, max(CASE WHEN i = floor(0.7::DOUBLE * n) THEN ts END) AS train_end, max(CASE WHEN i = floor(0.85::DOUBLE * n) THEN ts END) AS val_end FROM n GROUP BY 1)"


@query("split_70_15_15", f"WITH {CUTS} SELECT series_id, ts, value, CASE WHEN ts < train_end THEN 'train' WHEN ts < val_end THEN 'validation' ELSE 'test' END AS partition FROM s JOIN c USING (series_id)")
def split_70_15_15(spark, sf_dir):
    df = daily(spark, sf_dir)
    return clean.split(df, clean.cut_points(df))


@query("finite_filter", f"SELECT * FROM ({INTRADAY}) WHERE value <> 0 AND isfinite(ln(CASE WHEN value > 0 THEN value END))")
def finite_filter(spark, sf_dir):
    rows = intraday(spark, sf_dir).withColumn("x", F.when(F.col("value") > 0, F.log("value")).otherwise(F.lit(float("-inf"))))
    return clean.finite_rows(rows, "x").drop("x")


@query("timestamp_parser", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 MINUTE WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) WHEN 2 THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) END AS ts FROM orders")
def timestamp_parser(spark, sf_dir):
    text = F.expr("case o_orderkey % 4 when 0 then concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 01:30:00') when 1 then date_format(o_orderdate, 'yyyy-MM-dd') when 2 then date_format(o_orderdate, 'yyyy-MM') else 'n/a' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.parse_timestamp(text).alias("ts"))


@query("synthetic_timestamps", f"SELECT series_id, row_number() OVER {W} AS t, CAST(DATE '2000-01-01' + CAST(row_number() OVER {W} - 1 AS INTEGER) AS TIMESTAMP) AS ts FROM ({INTRADAY})")
def synthetic_timestamps(spark, sf_dir):
    return clean.daily_timestamps(numbered_bars(intraday(spark, sf_dir)).select(SERIES, "t")).select(SERIES, "t", "ts")


@query("series_values", f"SELECT series_id, row_number() OVER {W} AS t, value FROM ({DAILY})")
def series_values(spark, sf_dir):
    return numbered_bars(daily(spark, sf_dir)).select(SERIES, "t", "value")


@query("sanitize_names", "SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(p_name || ' / ' || p_brand || '!', '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM part")
def sanitize_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(C.sanitize_name(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))).alias("name")).distinct()


# --- features ----------------------------------------------------------------------------------

for _name, _family, _expr in (("log_return", "log_return", "r"), ("abs_return", "abs_return", "abs(r)"), ("sq_return", "squared_return", "r * r")):
    for _session in (False, True):
        _key = _name + ("_session" if _session else "")
        query(_key, f"WITH {returns_sql(INTRADAY, _session)} SELECT series_id, ts, {R(_expr, 9)} AS y FROM ret")(lambda spark, sf_dir, f=_family, s=_session: neat(features.returns(intraday(spark, sf_dir), f, s), 9))


def rolling_sql(expr: str, source: str, session: bool, window: int = 5) -> str:
    part = "series_id, CAST(ts AS DATE)" if session else "series_id"
    frame = f"(PARTITION BY {part} ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return f"WITH {returns_sql(source, session)}, v AS (SELECT series_id, ts, r, count(r) OVER {frame} AS n, stddev_pop(r) OVER {frame} AS vol, avg(r) OVER {frame} AS m FROM ret) SELECT series_id, ts, {R(expr)} AS y FROM v WHERE n = {window}"


@query("rolling_vol", rolling_sql("vol", DAILY, False, 20))
def rolling_vol(spark, sf_dir):
    return neat(features.rolling(daily(spark, sf_dir), "rolling_vol", 20))


@query("rolling_vol_session", rolling_sql("vol", INTRADAY, True))
def rolling_vol_session(spark, sf_dir):
    return neat(features.rolling(intraday(spark, sf_dir), "rolling_vol", 5, True))


@query("rolling_mean", rolling_sql("m", INTRADAY, False))
def rolling_mean(spark, sf_dir):
    return neat(features.rolling_mean(intraday(spark, sf_dir), 5))


@query("std_return", rolling_sql("r / (vol + 0.01::DOUBLE)", INTRADAY, False))
def std_return(spark, sf_dir):
    return neat(features.rolling(intraday(spark, sf_dir), "standardized_return", 5, epsilon=0.01))


@query("std_return_session", rolling_sql("r / (vol + 0.01::DOUBLE)", INTRADAY, True))
def std_return_session(spark, sf_dir):
    return neat(features.rolling(intraday(spark, sf_dir), "standardized_return", 5, True, 0.01))


@query("zscore_train", f"WITH {OBS} SELECT series_id, t, ts, {R('y')} AS y FROM obs")
def zscore_train(spark, sf_dir):
    return neat(obs(spark, sf_dir))


@query("robust_zscore_train", f"WITH {OBS}, q AS (SELECT series_id, quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.5) AS m, quantile_cont(r, 0.75) AS b FROM feat JOIN ntr USING (series_id) WHERE t <= n GROUP BY 1) SELECT series_id, t, ts, {R('(r - m) / CASE WHEN b = a THEN 1 ELSE b - a END')} AS y FROM feat JOIN q USING (series_id)")
def robust_zscore_train(spark, sf_dir):
    return neat(features.stream(intraday(spark, sf_dir), features.Feature(scaling="robust_zscore")))


@query("identity_scaler", f"WITH {OBS} SELECT series_id, t, ts, {R('r')} AS y FROM feat")
def identity_scaler(spark, sf_dir):
    return neat(features.stream(intraday(spark, sf_dir), features.Feature(scaling="none")))


@query("zscore_train_strict", f"WITH {OBS}, s2 AS (SELECT series_id, avg(r) AS loc, stddev_pop(r) AS sc FROM feat JOIN ntr USING (series_id) WHERE t <= n - 1 GROUP BY 1) SELECT series_id, t, ts, {R('(r - s2.loc) / CASE WHEN s2.sc = 0 THEN 1 ELSE s2.sc END')} AS y FROM feat JOIN s2 USING (series_id)")
def zscore_train_strict(spark, sf_dir):
    return neat(features.stream(intraday(spark, sf_dir), features.Feature(), strict=True))


@query("percentiles", f"SELECT series_id, {', '.join(f'{R(f'quantile_cont(value, {p})')} AS q{p * 100:02.0f}' for p in (0.01, 0.05, 0.25, 0.5, 0.95))} FROM ({INTRADAY}) GROUP BY 1")
def percentiles(spark, sf_dir):
    ps = (0.01, 0.05, 0.25, 0.5, 0.95)
    q = intraday(spark, sf_dir).groupBy(SERIES).agg(F.percentile("value", F.array(*map(F.lit, ps))).alias("q"))
    return neat(q.select(SERIES, *[F.col("q")[i].alias(f"q{p * 100:02.0f}") for i, p in enumerate(ps)]))


@query("feature_summary", f"WITH {OBS} SELECT series_id, count(*)::BIGINT AS n, {R('avg(y)')} AS mean, {R('var_pop(y)')} AS variance, {R('min(y)')} AS min, {R('max(y)')} AS max FROM obs GROUP BY 1")
def feature_summary(spark, sf_dir):
    return neat(features.summary(obs(spark, sf_dir)))


# --- model -------------------------------------------------------------------------------------


@query("emission", f"WITH {OBS} SELECT series_id, t, {', '.join(f'{R(f'-0.9189385332046728 - 0.5 * ln({VA[j]}) - 0.5 * (y - ({MU[j]})) * (y - ({MU[j]})) / {VA[j]}')} AS log_density_{j}' for j in range(2))} FROM obs")
def emission(spark, sf_dir):
    return neat(hmm.emission(obs(spark, sf_dir), MODEL).select(SERIES, "t", "log_density_0", "log_density_1"))


@query("log_sum_exp", f"WITH {OBS}, e AS (SELECT series_id, t, {', '.join(f'-0.9189385332046728 - 0.5 * ln({VA[j]}) - 0.5 * (y - ({MU[j]})) * (y - ({MU[j]})) / {VA[j]} AS l{j}' for j in range(2))} FROM obs) SELECT series_id, t, {R('greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1)))')} AS lse FROM e")
def log_sum_exp(spark, sf_dir):
    rows = hmm.emission(obs(spark, sf_dir), MODEL)
    return neat(rows.select(SERIES, "t", C.log_sum_exp(F.array("log_density_0", "log_density_1")).alias("lse")))


def two(c: str, name: str) -> list:
    return [F.col(c)[j].alias(f"{name}{j}") for j in range(2)]


FILTERED = f"SELECT series_id, t, {R('q0')} AS q0, {R('q1')} AS q1, {R('f0')} AS f0, {R('f1')} AS f1, {R('log_c')} AS log_c FROM flt"


@query("forward_filter", f"{OFFLINE} {FILTERED}")
def forward_filter(spark, sf_dir):
    return neat(model_rows(spark, sf_dir, False).select(SERIES, "t", *two("predicted", "q"), *two("filtered", "f"), "log_c"))


@query("online_filter", f"{ONLINE} {FILTERED}")
def online_filter(spark, sf_dir):
    return neat(model_rows(spark, sf_dir, True).select(SERIES, "t", *two("predicted", "q"), *two("filtered", "f"), "log_c"))


@query("blocked_filter", f"{ONLINE} {FILTERED}")
def blocked_filter(spark, sf_dir):
    rows = scan.blocked_filter(obs(spark, sf_dir), MODEL, True, 512)
    return neat(rows.select(SERIES, "t", *two("predicted", "q"), *two("filtered", "f"), "log_c"))


@query("loglik", f"{OFFLINE} SELECT series_id, count(*)::BIGINT AS n, {R('sum(log_c)', 4)} AS log_likelihood FROM flt GROUP BY 1")
def loglik(spark, sf_dir):
    return neat(hmm.log_likelihood(model_rows(spark, sf_dir, False)), 4)


@query("smoother", f"{SMOOTH} SELECT series_id, t, {R('g0')} AS g0, {R('g1')} AS g1 FROM sm")
def smoother(spark, sf_dir):
    return neat(hmm.smooth_rows(obs(spark, sf_dir), MODEL).select(SERIES, "t", *two("smoothed", "g")))


@query("blocked_smoother", ORACLE_SQL["smoother"])
def blocked_smoother(spark, sf_dir):
    return neat(scan.blocked_smoother(obs(spark, sf_dir), MODEL, 512).select(SERIES, "t", *two("smoothed", "g")))


@query("pairwise", f"{SMOOTH} SELECT series_id, t, {', '.join(f'{R(f'x{i}{j}')} AS x{i}{j}' for i in range(2) for j in range(2))} FROM xi")
def pairwise(spark, sf_dir):
    xi = hmm.pairwise(hmm.smooth_rows(obs(spark, sf_dir), MODEL), MODEL.transition)
    return neat(xi.select(SERIES, "t", *[F.col("xi")[i][j].alias(f"x{i}{j}") for i in range(2) for j in range(2)]))


@query("expected_transitions", f"{SMOOTH} " + " UNION ALL ".join(f"SELECT series_id, {i}::BIGINT AS from_regime, {j}::BIGINT AS to_regime, {R(f'sum(x{i}{j})')} AS expected FROM xi GROUP BY 1" for i in range(2) for j in range(2)))
def expected_transitions(spark, sf_dir):
    return neat(hmm.expected_transitions(hmm.pairwise(hmm.smooth_rows(obs(spark, sf_dir), MODEL), MODEL.transition), 2))


@query("em_init", f"WITH {OBS}, b AS (SELECT series_id, y, least((row_number() OVER (PARTITION BY series_id ORDER BY y) - 1) // greatest(count(*) OVER (PARTITION BY series_id) // 3, 1), 2) AS j FROM obs) SELECT series_id, j::BIGINT AS regime, {R('avg(y)')} AS mean, {R('greatest(var_pop(y), 1e-6)')} AS variance FROM b GROUP BY series_id, j")
def em_init(spark, sf_dir):
    p = hmm.initial_params(obs(spark, sf_dir), 3)
    return neat(p.select(SERIES, F.posexplode(F.arrays_zip("means", "variances")).alias("regime", "z")).select(SERIES, "regime", F.col("z.means").alias("mean"), F.col("z.variances").alias("variance")))


EM_STEP = f"""{SMOOTH}, w AS (SELECT series_id, sum(g0) AS w0, sum(g1) AS w1, sum(g0 * y) / sum(g0) AS m0, sum(g1 * y) / sum(g1) AS m1, sum(g0) FILTER (t < n) AS l0, sum(g1) FILTER (t < n) AS l1, max(g0) FILTER (t = 1) AS pi0, sum(log_c) AS ll FROM sm GROUP BY 1),
v AS (SELECT sm.series_id, sum(g0 * (y - m0) * (y - m0)) / any_value(w0) AS v0, sum(g1 * (y - m1) * (y - m1)) / any_value(w1) AS v1 FROM sm JOIN w USING (series_id) GROUP BY 1),
x AS (SELECT series_id, sum(x00) AS s00, sum(x01) AS s01, sum(x10) AS s10, sum(x11) AS s11 FROM xi GROUP BY 1)
SELECT series_id, {R('pi0')} AS pi0, {R('s00 / l0')} AS p00, {R('s11 / l1')} AS p11, {R('m0')} AS m0, {R('m1')} AS m1, {R('greatest(v0, 1e-6)')} AS v0, {R('greatest(v1, 1e-6)')} AS v1, {R('ll', 4)} AS log_likelihood FROM w JOIN v USING (series_id) JOIN x USING (series_id)"""


@query("em_one_step", EM_STEP)
def em_one_step(spark, sf_dir):
    s = hmm.em_step(obs(spark, sf_dir), MODEL)
    out = s.select(SERIES, F.col("pi")[0].alias("pi0"), F.col("transition")[0][0].alias("p00"), F.col("transition")[1][1].alias("p11"), F.col("means")[0].alias("m0"), F.col("means")[1].alias("m1"), F.col("variances")[0].alias("v0"), F.col("variances")[1].alias("v1"), F.round("log_likelihood", 4).alias("log_likelihood"))
    return neat(out)


@query("blocked_em_step", EM_STEP)
def blocked_em_step(spark, sf_dir):
    """em_one_step in blocks of 700 rows, several for each series."""
    s = scan.blocked_em_step(obs(spark, sf_dir), MODEL, 700)
    out = s.select(SERIES, F.col("pi")[0].alias("pi0"), F.col("transition")[0][0].alias("p00"), F.col("transition")[1][1].alias("p11"), F.col("means")[0].alias("m0"), F.col("means")[1].alias("m1"), F.col("variances")[0].alias("v0"), F.col("variances")[1].alias("v1"), F.round("log_likelihood", 4).alias("log_likelihood"))
    return neat(out)


def fits(spark: SparkSession, sf_dir: str, n_starts: int = 1, jitter: float = 0.0) -> DataFrame:
    return hmm.fit_em(obs(spark, sf_dir), 2, n_starts=n_starts, jitter=jitter)


def em_iteration_sql(i: int) -> str:
    """flt{i}, the filter of the parameters par{i} of each series, and par{i + 1}, the parameters after a step of EM."""
    den = ", ".join(f"exp(-0.5 * (o.y - m{j}) * (o.y - m{j}) / v{j}) / sqrt(v{j}) AS d{j}" for j in (0, 1))
    step = "SELECT series_id, t, y, q0, q1, q0 * d0 / (q0 * d0 + q1 * d1) AS f0, q1 * d1 / (q0 * d0 + q1 * d1) AS f1, ln(q0 * d0 + q1 * d1) - 0.9189385332046728 AS log_c FROM"
    return f"""flt{i} AS (
  {step} (SELECT o.series_id, o.t, o.y, pi0 AS q0, pi1 AS q1, {den} FROM obs o JOIN par{i} USING (series_id) WHERE o.t = 1)
  UNION ALL
  {step} (SELECT o.series_id, o.t, o.y, f.f0 * a00 + f.f1 * a10 AS q0, f.f0 * a01 + f.f1 * a11 AS q1, {den} FROM flt{i} f JOIN obs o ON o.series_id = f.series_id AND o.t = f.t + 1 JOIN par{i} p ON p.series_id = o.series_id)),
nxt{i} AS (SELECT *, lead(q0) OVER {WT} AS n0, lead(q1) OVER {WT} AS n1, lag(f0) OVER {WT} AS b0, lag(f1) OVER {WT} AS b1, count(*) OVER (PARTITION BY series_id) AS n FROM flt{i}),
smo{i} AS (
  SELECT series_id, t, f0 AS g0, f1 AS g1 FROM nxt{i} WHERE t = n
  UNION ALL
  SELECT series_id, t, u0 / (u0 + u1), u1 / (u0 + u1) FROM (
    SELECT x.series_id, x.t, x.f0 * (a00 * s.g0 / x.n0 + a01 * s.g1 / x.n1) AS u0, x.f1 * (a10 * s.g0 / x.n0 + a11 * s.g1 / x.n1) AS u1
    FROM smo{i} s JOIN nxt{i} x ON x.series_id = s.series_id AND x.t = s.t - 1 JOIN par{i} p ON p.series_id = x.series_id)),
sm{i} AS (SELECT x.*, g0, g1, a00, a01, a10, a11 FROM nxt{i} x JOIN smo{i} USING (series_id, t) JOIN par{i} USING (series_id)),
w{i} AS (SELECT series_id, sum(g0) AS w0, sum(g1) AS w1, sum(g0 * y) / sum(g0) AS m0, sum(g1 * y) / sum(g1) AS m1, sum(g0) FILTER (t < n) AS l0, sum(g1) FILTER (t < n) AS l1, max(g0) FILTER (t = 1) AS pi0, max(g1) FILTER (t = 1) AS pi1,
  {", ".join(f"sum(b{a} * a{a}{b} * g{b} / q{b}) FILTER (t > 1) AS s{a}{b}" for a in (0, 1) for b in (0, 1))} FROM sm{i} GROUP BY 1),
v{i} AS (SELECT x.series_id, greatest(sum(g0 * (y - m0) * (y - m0)) / any_value(w0), 1e-6) AS v0, greatest(sum(g1 * (y - m1) * (y - m1)) / any_value(w1), 1e-6) AS v1 FROM sm{i} x JOIN w{i} USING (series_id) GROUP BY 1),
par{i + 1} AS (SELECT series_id, pi0, pi1, s00 / (s00 + s01) AS a00, s01 / (s00 + s01) AS a01, s10 / (s10 + s11) AS a10, s11 / (s10 + s11) AS a11, m0, m1, v0, v1 FROM w{i} JOIN v{i} USING (series_id))"""


def em_sql(iterations: int) -> str:
    """Parameters after so many steps of EM from the starting values of two regimes, and the log-likelihoods on the way, as (series_id, i, ll) in hist."""
    history = " UNION ALL ".join(f"SELECT series_id, {i} AS i, sum(log_c) AS ll FROM flt{i} GROUP BY 1" for i in range(iterations + 1))
    return f"""WITH RECURSIVE {OBS}, half AS (SELECT series_id, y, least((row_number() OVER (PARTITION BY series_id ORDER BY y) - 1) // greatest(count(*) OVER (PARTITION BY series_id) // 2, 1), 1) AS j FROM obs),
par0 AS (SELECT series_id, 0.5::DOUBLE AS pi0, 0.5::DOUBLE AS pi1, 0.9::DOUBLE AS a00, 0.1::DOUBLE AS a01, 0.1::DOUBLE AS a10, 0.9::DOUBLE AS a11, avg(y) FILTER (j = 0) AS m0, avg(y) FILTER (j = 1) AS m1, greatest(var_pop(y) FILTER (j = 0), 1e-6) AS v0, greatest(var_pop(y) FILTER (j = 1), 1e-6) AS v1 FROM half GROUP BY 1),
{", ".join(em_iteration_sql(i) for i in range(iterations + 1))}, hist AS ({history})"""


@query("em_iterations", f"{em_sql(3)} SELECT series_id, {', '.join(f'{R(a)} AS {b}' for a, b in (('pi0', 'pi0'), ('a00', 'p00'), ('a11', 'p11'), ('m0', 'm0'), ('m1', 'm1'), ('v0', 'v0'), ('v1', 'v1')))}, {R('ll', 4)} AS log_likelihood FROM par3 JOIN hist USING (series_id) WHERE i = 3")
def em_iterations(spark, sf_dir):
    """The EM loop's first three steps from its own start; em_fit goes on until it converges."""
    f = hmm.fit_em(obs(spark, sf_dir), 2, tol=0.0, max_iter=3)
    m, v, tr = F.col("means"), F.col("variances"), F.col("transition")
    return neat(f.select(SERIES, F.col("pi")[0].alias("pi0"), tr[0][0].alias("p00"), tr[1][1].alias("p11"), m[0].alias("m0"), m[1].alias("m1"), v[0].alias("v0"), v[1].alias("v1"), F.round("log_likelihood", 4).alias("log_likelihood")))


@query("em_history", f"{em_sql(3)}, d AS (SELECT series_id, i, ll, ll - lag(ll) OVER (PARTITION BY series_id ORDER BY i) AS d FROM hist) SELECT series_id, 0::BIGINT AS start, {R('max(ll) FILTER (i = 3) - max(ll) FILTER (i = 0)', 4)} AS gain, {R('min(d)', 4)} AS min_delta, {R('greatest(-min(d), 0.0)', 4)} AS largest_drop, min(d) >= -1e-8 AS monotone FROM d GROUP BY 1")
def em_history(spark, sf_dir):
    """The convergence summary of the same three steps."""
    return neat(hmm.convergence(hmm.fit_em(obs(spark, sf_dir), 2, tol=0.0, max_iter=3)), 4)


@query("em_fit")
def em_fit(spark, sf_dir):
    return hmm.by_mean(fits(spark, sf_dir)).select(SERIES, "k", "pi", "transition", "means", "variances", "log_likelihood", "n_iter", "converged")


@query("em_multi_start")
def em_multi_start(spark, sf_dir):
    return hmm.compare_runs(fits(spark, sf_dir, 3, 0.5))


@query("convergence")
def convergence(spark, sf_dir):
    return hmm.convergence(fits(spark, sf_dir))


@query("param_validity")
def param_validity(spark, sf_dir):
    return hmm.param_validity(fits(spark, sf_dir))


@query("posterior_validity", f"""{SMOOTH}, z AS (SELECT sm.series_id, abs(f0 + f1 - 1) AS df, abs(g0 + g1 - 1) AS dg, abs(x00 + x01 + x10 + x11 - 1) AS dx, greatest(abs(x00 + x10 - g0), abs(x01 + x11 - g1)) AS dm FROM sm LEFT JOIN xi ON xi.series_id = sm.series_id AND xi.t = sm.t)
SELECT series_id, {R('max(df)')} AS max_filtered_dev, {R('max(dg)')} AS max_smoothed_dev, {R('max(dx)')} AS max_xi_dev, {R('max(dm)')} AS max_marginal_dev FROM z GROUP BY 1""")
def posterior_validity(spark, sf_dir):
    s = hmm.smooth_rows(obs(spark, sf_dir), MODEL)
    return neat(hmm.posterior_validity(s, hmm.pairwise(s, MODEL.transition)))


@query("regime_summary", f"{SMOOTH}, r AS (SELECT series_id, 0::BIGINT AS regime, avg(g0) AS occupancy, sum((g1 < g0)::INT)::BIGINT AS hard_count FROM sm GROUP BY 1 UNION ALL SELECT series_id, 1, avg(g1), sum((g1 >= g0)::INT)::BIGINT FROM sm GROUP BY 1) SELECT series_id, regime, {R('occupancy')} AS occupancy, hard_count, CASE regime WHEN 0 THEN {TR[0][0]}::DOUBLE ELSE {TR[1][1]}::DOUBLE END AS self_prob, {R(f'CASE regime WHEN 0 THEN 1 / (1 - {TR[0][0]}::DOUBLE) ELSE 1 / (1 - {TR[1][1]}::DOUBLE) END')} AS expected_duration, CASE regime WHEN 0 THEN ({MU[0]})::DOUBLE ELSE {MU[1]}::DOUBLE END AS mean, CASE regime WHEN 0 THEN {VA[0]}::DOUBLE ELSE {VA[1]}::DOUBLE END AS variance FROM r")
def regime_summary(spark, sf_dir):
    return neat(hmm.regime_summary(hmm.smooth_rows(obs(spark, sf_dir), MODEL), MODEL))


@query("diagnose", f"""{em_sql(3)}, d AS (SELECT series_id, min(ll - before) AS least FROM (SELECT series_id, ll, lag(ll) OVER (PARTITION BY series_id ORDER BY i) AS before FROM hist) GROUP BY 1),
o AS (SELECT series_id, avg(g0) AS o0, avg(g1) AS o1, sum((g1 < g0)::INT)::BIGINT AS h0, sum((g1 >= g0)::INT)::BIGINT AS h1, max(abs(f0 + f1 - 1)) AS df, max(abs(g0 + g1 - 1)) AS dg,
  max(abs(b0 * a00 * g0 / q0 + b1 * a10 * g0 / q0 + b0 * a01 * g1 / q1 + b1 * a11 * g1 / q1 - 1)) FILTER (t > 1) AS dx, max(greatest(abs(b0 * a00 * g0 / q0 + b1 * a10 * g0 / q0 - g0), abs(b0 * a01 * g1 / q1 + b1 * a11 * g1 / q1 - g1))) FILTER (t > 1) AS dm FROM sm3 GROUP BY 1)
SELECT series_id, {R('o0')} AS occupancy0, {R('o1')} AS occupancy1, h0 AS hard_count0, h1 AS hard_count1, {R('a00')} AS self_prob0, {R('a11')} AS self_prob1, {R('1 / (1 - a00)', 4)} AS expected_duration0, {R('1 / (1 - a11)', 4)} AS expected_duration1,
  isfinite(pi0 + a00 + a11 + m0 + m1 + v0 + v1) AND v0 > 0 AND v1 > 0 AND abs(pi0 + pi1 - 1) <= 1e-9 AND abs(a00 + a01 - 1) <= 1e-9 AND abs(a10 + a11 - 1) <= 1e-9 AS valid, least >= -1e-8 AS monotone,
  (v0 < 1e-4)::BIGINT + (v1 < 1e-4)::BIGINT + (o0 < 0.01)::BIGINT + (o1 < 0.01)::BIGINT + (a00 > 1 - 1e-6)::BIGINT + (a11 > 1 - 1e-6)::BIGINT + (least < -1e-8)::BIGINT AS n_warnings, greatest(df, dg, dx, dm) < 1e-8 AS trustworthy
FROM o JOIN par3 USING (series_id) JOIN d USING (series_id)""")
def diagnose(spark, sf_dir):
    """Diagnostics of the fits after three EM steps."""
    rows = obs(spark, sf_dir)
    got = hmm.diagnose(rows, hmm.fit_em(rows, 2, tol=0.0, max_iter=3))
    r = F.col("regimes")
    flat = {f"{c}{j}": r[j][c] for c in ("occupancy", "hard_count", "self_prob") for j in (0, 1)}
    out = neat(got.select(SERIES, *[x.alias(c) for c, x in flat.items()], "valid", "monotone", F.size("warnings").alias("n_warnings"), "trustworthy", *[r[j]["expected_duration"].alias(f"expected_duration{j}") for j in (0, 1)]))
    return out.withColumns({f"expected_duration{j}": F.round(f"expected_duration{j}", 4) for j in (0, 1)})


@query("diagnostic_warnings")
def diagnostic_warnings(spark, sf_dir):
    """Warnings of fits from two starts; regimes are those of the best fit."""
    return hmm.fit_warnings(obs(spark, sf_dir), fits(spark, sf_dir, 2, 0.5))


@query("changepoints", f"{ONLINE}, s AS (SELECT series_id, t, {TOP} AS state FROM flt) SELECT series_id, t FROM (SELECT *, lag(state) OVER {WT} AS b FROM s) WHERE state <> b")
def changepoints(spark, sf_dir):
    states = detect.with_dominant(model_rows(spark, sf_dir)).select(SERIES, "t", F.col("dominant").alias("state"))
    return hmm.change_points(states)


@query("stationary_pi", f"WITH RECURSIVE p AS (SELECT 0 AS i, 0.5::DOUBLE AS a, 0.5::DOUBLE AS b UNION ALL SELECT i + 1, a * {TR[0][0]} + b * {TR[1][0]}, a * {TR[0][1]} + b * {TR[1][1]} FROM p WHERE i < 256) SELECT unnest([0, 1])::BIGINT AS regime, unnest([{R('a')}, {R('b')}]) AS pi FROM p WHERE i = 256")
def stationary_pi(spark, sf_dir):
    return neat(spark.createDataFrame(list(enumerate(K.stationary(MODEL.transition).tolist())), "regime bigint, pi double"))


@query("simulate")
def simulate(spark, sf_dir):
    return hmm.simulate(spark, [(n, p, 2000, 42, 0.02 if n == "shock_contaminated" else 0.0, 5.0) for n, p in hmm.SCENARIOS.items()])


# --- detectors ---------------------------------------------------------------------------------


@query("dominant_regime", f"{ONLINE} SELECT series_id, t, ({TOP})::BIGINT AS dominant FROM flt")
def dominant_regime(spark, sf_dir):
    return neat(detect.with_dominant(model_rows(spark, sf_dir)).select(SERIES, "t", "dominant"))


_DETECTORS = {"det_hard_switch": ("hard_switch", 0.5, "score > 0"), "det_leave_previous": ("leave_previous", 0.3, "score >= 0.3"), "det_total_variation": ("total_variation", 0.3, "score >= 0.3"), "det_surprise": ("surprise", 2.5, "score >= 2.5")}
for _key, (_kind, _threshold, _cross) in _DETECTORS.items():
    query(_key, f"{scored_sql(_kind)} SELECT series_id, t, {R('score')} AS score, ready AND ({_cross}) AS crossed, ready FROM scored")(lambda spark, sf_dir, k=_kind, th=_threshold: neat(detect.score_rows(model_rows(spark, sf_dir), K.Detector(k, th))))

EMA = f"""{ONLINE}, ema AS (
  SELECT series_id, t, 0.0::DOUBLE AS score, -log_c AS base FROM flt WHERE t = 1
  UNION ALL
  SELECT f.series_id, f.t, -f.log_c - e.base, 0.3::DOUBLE * -f.log_c + (1 - 0.3::DOUBLE) * e.base FROM ema e JOIN flt f ON f.series_id = e.series_id AND f.t = e.t + 1),
scored AS (SELECT series_id, t, score, t > 1 AS ready FROM ema),
{persist_sql('score >= 2.0', 1, 3, 'scored')}"""


@query("det_surprise_ema", f"{EMA} SELECT s.series_id, s.t, {R('score')} AS score, ready, alarm FROM scored s JOIN per p ON p.series_id = s.series_id AND p.t = s.t")
def det_surprise_ema(spark, sf_dir):
    return neat(detect.alarms(model_rows(spark, sf_dir), K.Detector("surprise", 2.0, 1, 3, 0.3)).select(SERIES, "t", "score", "ready", "alarm"))


@query("alarms_persistence", f"{ALARMS} SELECT s.series_id, s.t, s.ts, score, ready, alarm, top::BIGINT AS dominant, top_before::BIGINT AS dominant_before FROM scored s JOIN per p ON p.series_id = s.series_id AND p.t = s.t")
def alarms_persistence(spark, sf_dir):
    return neat(detect.alarms(model_rows(spark, sf_dir), DET))


@query("blocked_alarms", ORACLE_SQL["alarms_persistence"])
def blocked_alarms(spark, sf_dir):
    return neat(scan.blocked_alarms(model_rows(spark, sf_dir), DET, 700))


@query("blocked_alarms_ema", ORACLE_SQL["det_surprise_ema"])
def blocked_alarms_ema(spark, sf_dir):
    return neat(scan.blocked_alarms(model_rows(spark, sf_dir), K.Detector("surprise", 2.0, 1, 3, 0.3), 700).select(SERIES, "t", "score", "ready", "alarm"))


@query("persistence_fold", f"{scored_sql('leave_previous')}, {persist_sql('score >= 0.3', 2, 3, 'scored')} SELECT series_id, count(*) FILTER (alarm)::BIGINT AS n_alarms, max(t) FILTER (alarm) AS last_alarm FROM per GROUP BY 1")
def persistence_fold(spark, sf_dir):
    return detect.persistence(detect.score_rows(model_rows(spark, sf_dir), K.Detector("leave_previous", 0.3)), 2, 3)


@query("alarm_events", f"{ALARMS} SELECT s.series_id, s.t, s.ts, score, 'hard_switch' AS detector_kind, top_before::BIGINT AS dominant_regime_before, top::BIGINT AS dominant_regime_after FROM scored s JOIN per p ON p.series_id = s.series_id AND p.t = s.t WHERE alarm")
def alarm_events(spark, sf_dir):
    rows = detect.alarms(model_rows(spark, sf_dir), DET).where("alarm")
    return neat(rows.select(SERIES, "t", "ts", "score", F.lit("hard_switch").alias("detector_kind"), F.col("dominant_before").alias("dominant_regime_before"), F.col("dominant").alias("dominant_regime_after")))


# --- evaluation --------------------------------------------------------------------------------

BARS = f"bars AS (SELECT series_id, row_number() OVER {W} AS t, ts, value FROM ({INTRADAY}))"
TRUTH = "truth AS (SELECT series_id, t FROM bars WHERE t % 37 = 5)"
EVAL_ALARMS = f"alarms AS (SELECT series_id, t FROM (SELECT series_id, t, value, lag(value) OVER {WT} AS p FROM bars) WHERE value > 1.6 * p AND t % 3 <> 0)"
MATCH = f"""WITH RECURSIVE {BARS}, {TRUTH}, {EVAL_ALARMS}, tr AS (SELECT series_id, t AS tau, row_number() OVER {WT} AS k FROM truth),
m AS (
  SELECT series_id, 0::BIGINT AS k, 0::BIGINT AS tau, NULL::BIGINT AS alarm, 0::BIGINT AS last FROM (SELECT DISTINCT series_id FROM truth)
  UNION ALL
  SELECT series_id, k, tau, CASE WHEN a < tau + 20 THEN a END, CASE WHEN a < tau + 20 THEN a ELSE last END FROM (
    SELECT m.series_id, tr.k, tr.tau, m.last, (SELECT min(t) FROM alarms al WHERE al.series_id = tr.series_id AND al.t >= tr.tau AND al.t > m.last) AS a FROM m JOIN tr ON tr.series_id = m.series_id AND tr.k = m.k + 1))"""


def eval_bars(spark, sf_dir) -> DataFrame:
    return numbered_bars(intraday(spark, sf_dir)).select(SERIES, "t", "ts", "value")


def eval_truth(bars: DataFrame) -> DataFrame:
    return bars.where("t % 37 = 5").select(SERIES, "t")


def eval_alarms(bars: DataFrame) -> DataFrame:
    p = F.lag("value").over(Window.partitionBy(SERIES).orderBy("t"))
    return bars.withColumn("p", p).where("value > 1.6 * p AND t % 3 <> 0").select(SERIES, "t")


@query("event_match", f"{MATCH} SELECT series_id, tau, alarm, alarm - tau AS delay FROM m WHERE k > 0")
def event_match(spark, sf_dir):
    bars = eval_bars(spark, sf_dir)
    return evaluate.match_events(eval_truth(bars), eval_alarms(bars), 20)


@query("metric_suite", f"""{MATCH}, mm AS (SELECT series_id, count(*) AS ne, count(alarm) AS tp, avg(alarm - tau) AS dm, quantile_cont(alarm - tau, 0.5) AS dd FROM m WHERE k > 0 GROUP BY 1),
aa AS (SELECT series_id, count(*) AS na FROM alarms GROUP BY 1), nn AS (SELECT series_id, count(*) AS n FROM bars GROUP BY 1)
SELECT series_id, ne AS n_events, na AS n_alarms, tp AS true_positives, na - tp AS false_positives, tp AS detected, ne - tp AS missed, {R('tp / na')} AS precision, {R('tp / ne')} AS recall, {R('(ne - tp) / ne')} AS miss_rate, {R('(na - tp) / n')} AS false_alarm_rate, {R('dm')} AS delay_mean, {R('dd')} AS delay_median FROM mm JOIN aa USING (series_id) JOIN nn USING (series_id)""")
def metric_suite(spark, sf_dir):
    bars = eval_bars(spark, sf_dir)
    alarms = eval_alarms(bars)
    lengths = bars.groupBy(SERIES).agg(F.count("*").alias("n"))
    return neat(evaluate.metric_suite(evaluate.match_events(eval_truth(bars), alarms, 20), alarms, lengths))


POINTS = "pts AS (SELECT e.event_type AS series_id, o.o_orderkey AS id, TIMESTAMP '2023-12-31 00:00:00' + to_minutes(o.o_orderkey % 46000) AS at FROM (SELECT DISTINCT event_type FROM events) e, orders o)"


def as_of_points(spark, sf_dir) -> DataFrame:
    """Every order looked up in every series, of which there are a handful."""
    names = sorted(r[0] for r in intraday(spark, sf_dir).select(SERIES).distinct().collect())
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.explode(F.array(*map(F.lit, names))).alias(SERIES))
    return rows.withColumn("at", F.expr("timestamp_ntz'2023-12-31 00:00:00' + make_dt_interval(0, 0, cast(id % 46000 as int))"))


@query("asof_forward", f"WITH {BARS}, {POINTS} SELECT p.series_id, p.id, p.at, b.t AS index FROM pts p ASOF LEFT JOIN bars b ON b.series_id = p.series_id AND b.ts >= p.at")
def asof_forward(spark, sf_dir):
    return evaluate.as_of(as_of_points(spark, sf_dir), eval_bars(spark, sf_dir).select(SERIES, "t", "ts"), True).select(SERIES, "id", "at", "index")


@query("asof_backward", f"WITH {BARS}, {POINTS} SELECT p.series_id, p.id, p.at, b.t AS index FROM pts p ASOF LEFT JOIN bars b ON b.series_id = p.series_id AND b.ts <= p.at")
def asof_backward(spark, sf_dir):
    return evaluate.as_of(as_of_points(spark, sf_dir), eval_bars(spark, sf_dir).select(SERIES, "t", "ts"), False).select(SERIES, "id", "at", "index")


EVENT_ROWS = [("a", "point", "2024-01-03 10:00:00", None), ("b", "point", "2024-01-03 13:00:00", None), ("c", "window", "2024-01-10 00:00:00", "2024-01-12 06:00:00"), ("d", "window", "2024-01-11 00:00:00", "2024-01-14 00:00:00"), ("e", "point", "2025-06-01 00:00:00", None), ("f", "point", "2023-01-01 00:00:00", None)]
EVENTS_SQL = "ev AS (SELECT s.series_id, e.id, e.kind, e.st, e.en FROM (SELECT DISTINCT series_id FROM bars) s, (VALUES " + ", ".join(f"('{i}', '{k}', TIMESTAMP '{a}', {f"TIMESTAMP '{b}'" if b else 'NULL::TIMESTAMP'})" for i, k, a, b in EVENT_ROWS) + ") AS e(id, kind, st, en))"
WINDOWS_SQL = """x AS (SELECT ev.*, (SELECT min(t) FROM bars b WHERE b.series_id = ev.series_id AND b.ts >= st) AS fi, (SELECT max(t) FROM bars b WHERE b.series_id = ev.series_id AND b.ts <= coalesce(en, st)) AS la, (SELECT max(t) FROM bars b WHERE b.series_id = ev.series_id) AS n FROM ev),
win AS (SELECT series_id, id, CASE WHEN ok THEN CASE kind WHEN 'point' THEN greatest(fi - 10, 1) ELSE fi END END AS l, CASE WHEN ok THEN CASE kind WHEN 'point' THEN least(fi + 20, n) ELSE la END END AS u, CASE WHEN ok THEN fi END AS ref FROM (SELECT *, fi IS NOT NULL AND (kind = 'point' OR la IS NOT NULL) AS ok FROM x)),
al AS (SELECT w.series_id, w.id, count(a.t) AS nm, min(a.t) AS fa, min(a.t) - any_value(ref) AS d FROM win w LEFT JOIN alarms a ON a.series_id = w.series_id AND a.t BETWEEN l AND u GROUP BY w.series_id, w.id)"""


def eval_events(spark, sf_dir) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(k).alias("kind"), F.lit(a).cast("timestamp_ntz").alias("start"), F.lit(b).cast("timestamp_ntz").alias("end")) for i, k, a, b in EVENT_ROWS])
    return intraday(spark, sf_dir).select(SERIES).distinct().select(SERIES, F.explode(kinds).alias("e")).select(SERIES, "e.*")


@query("event_windows", f"WITH {BARS}, {EVENTS_SQL}, alarms AS (SELECT series_id, t FROM bars WHERE false), {WINDOWS_SQL} SELECT series_id, id, l AS \"left\", u AS \"right\", ref AS reference FROM win")
def event_windows(spark, sf_dir):
    return evaluate.event_windows(eval_events(spark, sf_dir), eval_bars(spark, sf_dir), 10, 20)


def route_a_sql(r=R) -> str:
    return f"""WITH {BARS}, {EVAL_ALARMS}, {EVENTS_SQL}, {WINDOWS_SQL},
inb AS (SELECT series_id, count(*) AS ib FROM bars b WHERE EXISTS (SELECT 1 FROM win w WHERE w.series_id = b.series_id AND b.t BETWEEN l AND u) GROUP BY 1),
ina AS (SELECT series_id, count(*) AS ia FROM alarms b WHERE EXISTS (SELECT 1 FROM win w WHERE w.series_id = b.series_id AND b.t BETWEEN l AND u) GROUP BY 1),
na AS (SELECT series_id, count(*) AS na FROM alarms GROUP BY 1), nb AS (SELECT series_id, count(*) AS nb FROM bars GROUP BY 1),
e AS (SELECT series_id, count(*) AS ne, sum((nm > 0)::INT)::BIGINT AS nc, avg(d) AS md, quantile_cont(d, 0.5) AS dd, min(d) AS lo, max(d) AS hi FROM al GROUP BY 1),
z AS (SELECT series_id, ne, na, nc, coalesce(ia, 0) AS ia, coalesce(ib, 0) AS ib, nb, md, dd, lo, hi FROM e JOIN na USING (series_id) JOIN nb USING (series_id) LEFT JOIN ina USING (series_id) LEFT JOIN inb USING (series_id))
SELECT series_id, ne AS n_events, na AS n_alarms, nc AS n_events_covered, ia AS n_alarms_aligned, {r('nc / ne')} AS event_coverage, {r('ia / na')} AS alarm_relevance, {r('md')} AS mean_delay_bars, {r('dd')} AS median_delay_bars, lo AS min_delay_bars, hi AS max_delay_bars, {r('ia / ib')} AS alarm_density_in, {r('(na - ia) / (nb - ib)')} AS alarm_density_out FROM z"""


@query("route_a", route_a_sql())
def route_a(spark, sf_dir):
    bars = eval_bars(spark, sf_dir)
    return neat(evaluate.route_a(bars, eval_alarms(bars), eval_events(spark, sf_dir), 10, 20))


@query("event_alignment", f"WITH {BARS}, {EVAL_ALARMS}, {EVENTS_SQL}, {WINDOWS_SQL} SELECT series_id, id, nm AS n_matched, fa AS first_alarm, d AS first_delay FROM al")
def event_alignment(spark, sf_dir):
    bars = eval_bars(spark, sf_dir)
    return evaluate.align(evaluate.event_windows(eval_events(spark, sf_dir), bars, 10, 20), eval_alarms(bars))


@query("window_density", f"WITH {BARS}, {EVAL_ALARMS}, {EVENTS_SQL}, {WINDOWS_SQL} SELECT series_id, count(*) AS bars_outside FROM bars b WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.series_id = b.series_id AND b.t BETWEEN l AND u) GROUP BY 1")
def window_density(spark, sf_dir):
    bars = eval_bars(spark, sf_dir)
    windows = evaluate.event_windows(eval_events(spark, sf_dir), bars, 10, 20)
    return evaluate.in_windows(bars.select(SERIES, "t"), windows, False).groupBy(SERIES).agg(F.count("*").alias("bars_outside"))


SEG = f"{BARS}, {EVAL_ALARMS}, seg AS (SELECT b.series_id, b.t, b.value AS y, sum((a.t IS NOT NULL AND b.t > 1)::INT) OVER (PARTITION BY b.series_id ORDER BY b.t) AS s FROM bars b LEFT JOIN alarms a ON a.series_id = b.series_id AND a.t = b.t)"
SEGSUM = f"""{SEG}, dv AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id, s) AS d FROM seg), ld AS (SELECT *, lead(d) OVER (PARTITION BY series_id, s ORDER BY t) AS nx FROM dv),
ss AS (SELECT series_id, s::BIGINT AS segment_index, min(t) AS "start", max(t) AS "end", count(*) AS n, avg(y) AS mean, var_pop(y) AS variance, stddev_pop(y) AS std_dev, avg(abs(y)) AS mean_abs, quantile_cont(y, 0.05) AS q05, quantile_cont(y, 0.5) AS q50, quantile_cont(y, 0.95) AS q95, CASE WHEN count(*) < 2 THEN NULL WHEN sum(d * d) = 0 THEN 0 ELSE sum(d * nx) / sum(d * d) END AS acf1, count(*) < 5 AS is_short FROM ld GROUP BY series_id, s)"""


def eval_segments(spark, sf_dir) -> DataFrame:
    bars = eval_bars(spark, sf_dir)
    return evaluate.segments(bars.select(SERIES, "t", F.col("value").alias("y")), eval_alarms(bars))


@query("segments", f"WITH {SEG} SELECT series_id, s::BIGINT AS segment_index, min(t) AS \"start\", max(t) AS \"end\" FROM seg GROUP BY 1, 2")
def segments(spark, sf_dir):
    return eval_segments(spark, sf_dir).groupBy(SERIES, "segment_index").agg(F.min("t").alias("start"), F.max("t").alias("end"))


@query("segment_summary", f"WITH {SEGSUM} SELECT series_id, segment_index, \"start\", \"end\", n, {', '.join(f'{R(c)} AS {c}' for c in ('mean', 'variance', 'std_dev', 'mean_abs', 'q05', 'q50', 'q95', 'acf1'))}, is_short FROM ss")
def segment_summary(spark, sf_dir):
    return neat(evaluate.segment_summary(eval_segments(spark, sf_dir)))


@query("acf1", f"WITH b AS ({DAILY}), d AS (SELECT series_id, ts, value - avg(value) OVER (PARTITION BY series_id) AS d FROM b), n AS (SELECT *, lead(d) OVER {W} AS x FROM d) SELECT series_id, {R('sum(d * x) / sum(d * d)')} AS acf1 FROM n GROUP BY 1")
def acf1(spark, sf_dir):
    rows = numbered_bars(daily(spark, sf_dir)).withColumnRenamed("value", "y")
    return neat(evaluate.lag1([SERIES], rows))


CONTRAST = f"""{SEGSUM}, nx AS (SELECT *, lead(mean) OVER o AS m2, lead(variance) OVER o AS v2, lead(mean_abs) OVER o AS a2 FROM ss WINDOW o AS (PARTITION BY series_id ORDER BY segment_index)),
ct AS (SELECT series_id, segment_index, m2 - mean AS dm, v2 - variance AS dv, a2 - mean_abs AS da, CASE WHEN variance + v2 = 0 THEN 0 ELSE (m2 - mean) / sqrt((variance + v2) / 2) END AS es FROM nx WHERE m2 IS NOT NULL)"""


@query("segment_contrast", f"WITH {CONTRAST} SELECT series_id, segment_index, {R('dm')} AS delta_mean, {R('dv')} AS delta_variance, {R('da')} AS delta_mean_abs, {R('es')} AS effect_size FROM ct")
def segment_contrast(spark, sf_dir):
    return neat(evaluate.adjacent_contrasts(evaluate.segment_summary(eval_segments(spark, sf_dir))))


def route_b_sql(r=R) -> str:
    return f"WITH {CONTRAST}, a AS (SELECT series_id, count(*) AS ns, sum(is_short::INT)::BIGINT AS sh, avg(n) AS ml, avg(variance) AS v FROM ss GROUP BY 1), b AS (SELECT series_id, avg(abs(dm)) AS dm, avg(abs(dv)) AS dv FROM ct GROUP BY 1) SELECT series_id, ns AS n_segments, sh AS n_short_segments, {r('ml')} AS mean_segment_len, {r('v')} AS mean_within_variance, {r('dm')} AS mean_abs_delta_mean, {r('dv')} AS mean_abs_delta_variance, {r('dm / sqrt(v)')} AS coherence FROM a JOIN b USING (series_id)"


@query("route_b_global", route_b_sql())
def route_b_global(spark, sf_dir):
    bars = eval_bars(spark, sf_dir)
    return neat(evaluate.route_b(bars.select(SERIES, "t", F.col("value").alias("y")), eval_alarms(bars)))


def exact(x: str, digits: int = 6) -> str:
    return f"CAST({x} AS DOUBLE)"


_WHOLE = ("n_events", "n_alarms", "n_events_covered", "n_alarms_aligned", "min_delay_bars", "max_delay_bars", "n_segments", "n_short_segments")
_SHARES = ("event_coverage", "alarm_relevance", "mean_delay_bars", "median_delay_bars", "alarm_density_in", "alarm_density_out", "mean_segment_len", "mean_within_variance", "mean_abs_delta_mean", "mean_abs_delta_variance", "coherence")


@query("real_evaluation", f"SELECT series_id, {', '.join(_WHOLE)}, {', '.join(f'{R(c)} AS {c}' for c in _SHARES)}, {R('(event_coverage + alarm_relevance + coherence) / 3')} AS score FROM ({route_a_sql(exact)}) JOIN ({route_b_sql(exact)}) USING (series_id)")
def real_evaluation(spark, sf_dir):
    bars = eval_bars(spark, sf_dir).withColumnRenamed("value", "y")
    return neat(evaluate.real_evaluation(bars, eval_alarms(bars.withColumnRenamed("y", "value")), eval_events(spark, sf_dir), 10, 20))


@query("alarm_sanitise", f"WITH {BARS}, n AS (SELECT series_id, count(*) AS n FROM bars GROUP BY 1), a AS (SELECT series_id, t * 2 - 5 AS t FROM bars UNION ALL SELECT series_id, t FROM bars WHERE t % 2 = 1) SELECT DISTINCT series_id, t FROM a JOIN n USING (series_id) WHERE t BETWEEN 1 AND n")
def alarm_sanitise(spark, sf_dir):
    bars = eval_bars(spark, sf_dir)
    raw = bars.select(SERIES, (F.col("t") * 2 - 5).alias("t")).unionByName(bars.where("t % 2 = 1").select(SERIES, "t"))
    return clean.alarm_times(raw, bars.groupBy(SERIES).agg(F.count("*").alias("n")))


# --- calibration and search --------------------------------------------------------------------

EMPIRICAL = f"""{OBS}, b AS (SELECT series_id, count(*) AS n, avg(y) AS mean, var_pop(y) AS variance, stddev_pop(y) AS std_dev, {', '.join(f'quantile_cont(y, {q}) AS q{c}' for q, c in ((0.01, '01'), (0.05, '05'), (0.5, '50'), (0.95, '95'), (0.99, '99')))} FROM obs GROUP BY 1),
tl AS (SELECT o.series_id, avg((y > q95)::INT) AS tail, avg((abs(y) > 2 * std_dev)::INT) AS ex FROM obs o JOIN b USING (series_id) GROUP BY 1),
d1 AS (SELECT series_id, t, y, y - avg(y) OVER (PARTITION BY series_id) AS d, abs(y) - avg(abs(y)) OVER (PARTITION BY series_id) AS e, lag(y) OVER {WT} AS p FROM obs),
d2 AS (SELECT *, lead(d) OVER {WT} AS dn, lead(e) OVER {WT} AS en FROM d1),
ac AS (SELECT series_id, sum(d * dn) / sum(d * d) AS acf1, sum(e * en) / sum(e * e) AS abs_acf1, sum((y * p < 0)::INT) / sum((y * p <> 0)::INT) AS sc FROM d2 GROUP BY 1),
hi AS (SELECT o.series_id, t, abs(y) > abs(q95) AS h FROM obs o JOIN b USING (series_id)),
ru AS (SELECT *, t - row_number() OVER (PARTITION BY series_id, h ORDER BY t) AS g FROM hi), rl AS (SELECT series_id, h, g, count(*) AS len FROM ru GROUP BY 1, 2, 3),
ep AS (SELECT series_id, coalesce(avg(len) FILTER (h), 0) AS hm, coalesce(avg(len) FILTER (NOT h), 0) AS lm FROM rl GROUP BY 1),
emp AS (SELECT series_id, n, mean, variance, std_dev, q01, q05, q50, q95, q99, tail AS tail_freq_q95, ex AS abs_exceed_2std, acf1, abs_acf1, sc AS sign_change_rate, hm AS high_episode_mean, lm AS low_episode_mean FROM b JOIN tl USING (series_id) JOIN ac USING (series_id) JOIN ep USING (series_id))"""


@query("empirical_summary", f"WITH {EMPIRICAL} SELECT series_id, n, {', '.join(f'{R(c)} AS {c}' for c in calibrate.SUMMARY[1:])} FROM emp")
def empirical_summary(spark, sf_dir):
    return neat(calibrate.empirical_summary(obs(spark, sf_dir)))


@query("sign_change_rate", f"WITH {EMPIRICAL} SELECT series_id, {R('sign_change_rate')} AS sign_change_rate FROM emp")
def sign_change_rate(spark, sf_dir):
    return neat(calibrate.sign_change_rate(obs(spark, sf_dir)))


@query("episode_durations", f"WITH {EMPIRICAL} SELECT series_id, {R('high_episode_mean')} AS high_episode_mean, {R('low_episode_mean')} AS low_episode_mean FROM emp")
def episode_durations(spark, sf_dir):
    rows = obs(spark, sf_dir)
    return neat(calibrate.episode_means(rows, rows.groupBy(SERIES).agg(F.percentile("y", F.lit(0.95)).alias("threshold"))))


CALIBRATED = f"""WITH {EMPIRICAL}, lh AS (SELECT *, greatest(abs(q50 - q05) / 1.64485, 1e-6) AS s1, greatest(abs(q95 - q50) / 1.64485, 1e-6) AS s2, greatest(low_episode_mean, 2) AS d0, greatest(high_episode_mean, 2) AS d1 FROM emp),
vv AS (SELECT *, least(s1, s2) AS lo, greatest(s1, s2) AS hi FROM lh), rt AS (SELECT *, greatest(hi / lo, 1) AS ratio FROM vv),
cal AS (SELECT series_id, -0.25 * std_dev AS m0, 0.25 * std_dev AS m1, lo * lo * CASE WHEN ratio < 1.5 THEN ratio / 1.5 ELSE 1 END AS v0, hi * hi * CASE WHEN ratio < 1.5 THEN 1.5 / ratio ELSE 1 END AS v1, least(greatest(1 - 1 / d0, 1e-6), 1 - 1e-6) AS p00, least(greatest(1 - 1 / d1, 1e-6), 1 - 1e-6) AS p11 FROM rt)"""


@query("calibrated_params", f"{CALIBRATED} SELECT series_id, {', '.join(f'{R(c)} AS {c}' for c in ('m0', 'm1', 'v0', 'v1', 'p00', 'p11'))}, {R('(1 - p11) / (2 - p00 - p11)')} AS pi0 FROM cal")
def calibrated_params(spark, sf_dir):
    p = calibrate.calibrated_params(obs(spark, sf_dir), calibrate.Mapping(min_ratio=1.5))
    m, v, tr = F.col("means"), F.col("variances"), F.col("transition")
    return neat(p.select(SERIES, m[0].alias("m0"), m[1].alias("m1"), v[0].alias("v0"), v[1].alias("v1"), tr[0][0].alias("p00"), tr[1][1].alias("p11"), F.col("pi")[0].alias("pi0")))


#: The other policies of means and variances, three regimes among them; anchors of magnitude are the deviations of the halves about the median of |y|.
OTHER = f"""WITH {EMPIRICAL}, sz AS (SELECT series_id, y, abs(y) <= max(CASE WHEN i = n // 2 THEN abs(y) END) OVER (PARTITION BY series_id) AS small FROM
  (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY abs(y)) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM obs)),
mg AS (SELECT series_id, sqrt(greatest(var_pop(y) FILTER (small), 1e-12)) AS s1, sqrt(greatest(var_pop(y) FILTER (NOT small), 1e-12)) AS s2 FROM sz GROUP BY 1)"""


@query("calibrated_symmetric_ratio", f"WITH {EMPIRICAL} SELECT series_id, {R('mean - 0.5::DOUBLE * std_dev')} AS m0, {R('mean')} AS m1, {R('mean + 0.5::DOUBLE * std_dev')} AS m2, {R('0.4::DOUBLE * variance')} AS v0, {R('1.7::DOUBLE * variance')} AS v1, {R('3::DOUBLE * variance')} AS v2, 0.95::DOUBLE AS p00, 0.05::DOUBLE AS p01, 0.1::DOUBLE AS p12, 0.25::DOUBLE AS p20 FROM emp")
def calibrated_symmetric_ratio(spark, sf_dir):
    """Three regimes about the mean, variances in given ratios, given durations, each regime followed by the next."""
    m = calibrate.Mapping(k=3, means="symmetric", variances="ratio", low_mult=0.4, high_mult=3.0, durations=(20.0, 10.0, 4.0), symmetric=False)
    p = calibrate.calibrated_params(obs(spark, sf_dir), m)
    tr = F.col("transition")
    return neat(p.select(SERIES, *[F.col(c)[j].alias(f"{c[0]}{j}") for c in ("means", "variances") for j in range(3)], tr[0][0].alias("p00"), tr[0][1].alias("p01"), tr[1][2].alias("p12"), tr[2][0].alias("p20")))


@query("calibrated_baseline_magnitude", f"{OTHER} SELECT series_id, {R('mean')} AS m0, {R('mean')} AS m1, {R('least(s1, s2) ** 2')} AS v0, {R('greatest(s1, s2) ** 2')} AS v1 FROM emp JOIN mg USING (series_id)")
def calibrated_baseline_magnitude(spark, sf_dir):
    """Both regimes at the mean, variances from the small and the large half of the values."""
    p = calibrate.calibrated_params(obs(spark, sf_dir), calibrate.Mapping(means="baseline", variances="magnitude_conditioned"))
    return neat(p.select(SERIES, *[F.col(c)[j].alias(f"{c[0]}{j}") for c in ("means", "variances") for j in range(2)]))


@query("calibrated_quick_em")
def calibrated_quick_em(spark, sf_dir):
    return calibrate.calibrated_params(obs(spark, sf_dir), calibrate.Mapping(strategy="quick_em"))


HALVES = "real AS (SELECT series_id, count(*) AS n, avg(y) AS mean, var_pop(y) AS variance, stddev_pop(y) AS sd, quantile_cont(y, 0.05) AS q05, quantile_cont(y, 0.95) AS q95 FROM obs WHERE t % 2 = 0 GROUP BY 1), syn AS (SELECT series_id, avg(y) AS mean, var_pop(y) AS variance, stddev_pop(y) AS sd, quantile_cont(y, 0.05) AS q05, quantile_cont(y, 0.95) AS q95 FROM obs WHERE t % 2 = 1 GROUP BY 1)"


FIELDS = f"""fields AS (SELECT series_id, h, avg(y) AS mean, var_pop(y) AS variance, quantile_cont(y, 0.05) AS q05, quantile_cont(y, 0.95) AS q95, sum(e * en) / sum(e * e) AS abs_acf1, sum((y * p < 0)::INT) / sum((y * p <> 0)::INT) AS sign_change_rate
  FROM (SELECT *, lead(e) OVER hw AS en, lag(y) OVER hw AS p FROM (SELECT series_id, t, t % 2 AS h, y, abs(y) - avg(abs(y)) OVER (PARTITION BY series_id, t % 2) AS e FROM obs) WINDOW hw AS (PARTITION BY series_id, h ORDER BY t)) GROUP BY 1, 2)"""


def half_moments(spark, sf_dir, fields: tuple[str, ...]) -> DataFrame:
    """Summaries of the rows of even and of odd t, side by side: both halves in one pass."""
    rows = obs(spark, sf_dir).withColumn("half", F.col("t") % 2)
    return calibrate.halves(calibrate.moments(rows, "half"), fields, "half", 0, 1)


@query("calibration_verify", f"WITH {OBS}, {FIELDS}, f AS (" + " UNION ALL ".join(f"SELECT series_id, '{c}' AS field, r.{c} AS a, s.{c} AS b, {'abs(s.variance - r.variance) / greatest(abs(r.variance), 1e-12)' if c == 'variance' else f'abs(s.{c} - r.{c})'} AS e, {tol}::DOUBLE AS tol FROM (FROM fields WHERE h = 0) r JOIN (FROM fields WHERE h = 1) s USING (series_id)" for c, tol in (("mean", 0.25), ("variance", 0.5), ("q05", 0.3), ("q95", 0.3), ("abs_acf1", 0.2), ("sign_change_rate", 0.2))) + f") SELECT series_id, field, {R('a')} AS real, {R('b')} AS synthetic, {R('e')} AS error, tol AS tolerance, e <= tol AS ok FROM f")
def calibration_verify(spark, sf_dir):
    return neat(calibrate.verify(half_moments(spark, sf_dir, calibrate.FIELDS)))


@query("scale_check", f"WITH {OBS}, {HALVES} SELECT series_id, {R('r.sd')} AS real_std, {R('s.sd')} AS synthetic_std, {R('abs(s.sd - r.sd) / r.sd')} AS relative_error, abs(s.sd - r.sd) / r.sd <= 0.10 AS ok FROM real r JOIN syn s USING (series_id)")
def scale_check(spark, sf_dir):
    return neat(calibrate.scale_check(half_moments(spark, sf_dir, ("std_dev",))))


@query("calibration_workflow")
def calibration_workflow(spark, sf_dir):
    return calibrate.workflow(obs(spark, sf_dir), calibrate.Mapping())[2]


def grid_rows(spark, sf_dir) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    return search.rank(search.score_synthetic(search.alarm_grid(rows, "hard_switch", search.REAL_GRIDS["hard_switch"]), rows.where("t % 37 = 5").select(SERIES, "t"), 20))


GRID_POINTS = "pts AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS point, x::DOUBLE AS thr, y::BIGINT AS req, z::BIGINT AS cd FROM (SELECT unnest([0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8]) AS x, unnest(range(8)) AS a), (SELECT unnest([1, 2, 3, 5]) AS y, unnest(range(4)) AS b), (SELECT unnest([0, 3, 5, 10]) AS z, unnest(range(4)) AS c))"
#: Change points are 37 steps apart and windows 20 long, so an alarm belongs to one change point at most, and any alarm in its window finds it.
GRID = f"""{DETECT}, {GRID_POINTS}, st AS (SELECT series_id, t, t > 1 AS ready, coalesce(top <> top_before, false) AS moved, greatest(f0, f1) AS share FROM top),
per AS (
  SELECT series_id, point, thr, req, cd, 0::BIGINT AS t, 0::BIGINT AS c, 0::BIGINT AS rest, false AS alarm FROM (SELECT DISTINCT series_id FROM st), pts
  UNION ALL
  SELECT series_id, point, thr, req, cd, t, CASE WHEN NOT ready THEN c WHEN rest > 0 OR NOT cr OR c + 1 >= req THEN 0 ELSE c + 1 END,
    CASE WHEN NOT ready THEN rest WHEN rest > 0 THEN rest - 1 WHEN cr AND c + 1 >= req THEN cd ELSE 0 END, ready AND rest = 0 AND cr AND c + 1 >= req
  FROM (SELECT p.series_id, point, thr, req, cd, s.t, ready, moved AND share >= thr AS cr, c, rest FROM per p JOIN st s ON s.series_id = p.series_id AND s.t = p.t + 1)),
hit AS (SELECT series_id, point, thr, req, cd, max(t) AS n, count(*) FILTER (alarm) AS n_alarms, count(DISTINCT (t - 5) // 37) FILTER (alarm AND t >= 5 AND (t - 5) % 37 < 20) AS hits, count(*) FILTER (t % 37 = 5) AS events FROM per GROUP BY ALL),
sco AS (SELECT *, hits / events AS coverage, CASE WHEN n_alarms > 0 THEN hits / n_alarms ELSE 0.0::DOUBLE END AS precision FROM hit),
ranked AS (SELECT *, 0.5::DOUBLE * coverage + 0.5::DOUBLE * precision AS score, row_number() OVER (PARTITION BY series_id ORDER BY 0.5::DOUBLE * coverage + 0.5::DOUBLE * precision DESC, point) AS rank FROM sco)
SELECT series_id, point, thr AS threshold, req AS required, cd AS cooldown, n, n_alarms, {R('coverage')} AS coverage, {R('precision')} AS precision, {R('score')} AS score, rank FROM ranked"""


@query("grid_search", GRID)
def grid_search(spark, sf_dir):
    return neat(grid_rows(spark, sf_dir).drop("alarms"))


@query("top_n", f"{GRID} WHERE rank <= 10")
def top_n(spark, sf_dir):
    return neat(search.top(grid_rows(spark, sf_dir)).drop("alarms"))


@query("detector_grid", f"SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS point, x::DOUBLE AS threshold, y::BIGINT AS required, z::BIGINT AS cooldown FROM (SELECT unnest([0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8]) AS x, unnest(range(8)) AS a), (SELECT unnest([1, 2, 3, 5]) AS y, unnest(range(4)) AS b), (SELECT unnest([0, 3, 5, 10]) AS z, unnest(range(4)) AS c)")
def detector_grid(spark, sf_dir):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(search.REAL_GRIDS["hard_switch"].points())], "point bigint, threshold double, required bigint, cooldown bigint")


@query("search_models")
def search_models(spark, sf_dir):
    prices = daily(spark, sf_dir)
    bars = numbered_bars(prices)
    return neat(search.top(search.search_models(prices, bars.where("t % 37 = 5").select(SERIES, "t"), search.model_grid(), "surprise", search.REAL_GRIDS["surprise"])).drop("alarms"))


# --- further sources, checks and tables ----------------------------------------------------------

METAL = "to_json(named_struct('nominal', 'XAU', 'data', array(named_struct('date', date_format(o_orderdate, 'yyyy-MM-dd'), 'price', if(o_orderkey % 5 = 0, '.', cast(o_custkey as string))))))"
EQUITY = "concat('{\"Meta Data\": {\"2. Symbol\": \"SPY\"}, \"Time Series (Daily)\": {\"', date_format(o_orderdate, 'yyyy-MM-dd'), '\": {', if(o_orderkey % 3 = 0, '\"5. adjusted close\": \"7.5\", ', ''), '\"4. close\": \"', if(o_orderkey % 4 = 0, 'n/a', cast(o_custkey as string)), '\"}}}')"


@query("decode_metal", "SELECT 'gold' AS symbol, 'daily' AS \"interval\", 'XAU' AS name, 'USD' AS unit, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, o_custkey::DOUBLE AS value FROM orders WHERE o_orderkey % 5 <> 0")
def decode_metal(spark, sf_dir):
    return vendor.decode_metal(table(spark, sf_dir, "orders").select(F.lit("gold").alias("symbol"), F.lit("daily").alias("interval"), F.expr(METAL).alias("payload")))


@query("decode_equity", "SELECT 'spy' AS symbol, 'daily' AS \"interval\", 'SPY Adjusted Close' AS name, 'USD' AS unit, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, CASE WHEN o_orderkey % 3 = 0 THEN 7.5::DOUBLE ELSE o_custkey::DOUBLE END AS value FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 <> 0")
def decode_equity(spark, sf_dir):
    return vendor.decode_equity(table(spark, sf_dir, "orders").select(F.lit("spy").alias("symbol"), F.lit("daily").alias("interval"), F.expr(EQUITY).alias("payload")))


@query("instruments", "SELECT symbol, kind, n::BIGINT AS n_intervals FROM (VALUES ('wti', 'standard', 3), ('brent', 'standard', 3), ('natural_gas', 'standard', 3), ('copper', 'standard', 3), ('aluminum', 'standard', 3), ('wheat', 'standard', 3), ('corn', 'standard', 3), ('cotton', 'standard', 3), ('sugar', 'standard', 3), ('coffee', 'standard', 3), ('all_commodities', 'standard', 3), ('gold', 'metal', 3), ('silver', 'metal', 3), ('spy', 'equity', 8), ('qqq', 'equity', 8)) AS t(symbol, kind, n)")
def instruments(spark, sf_dir):
    rows = [(vendor.instrument(k.upper().replace("_", "-")), x[0], len(vendor.supported(k))) for k, x in vendor.INSTRUMENTS.items()]
    return spark.createDataFrame(rows, "symbol string, kind string, n_intervals bigint")


@query("truth_validation", f"WITH {BARS}, n AS (SELECT series_id, count(*) AS n FROM bars GROUP BY 1), tr AS (SELECT series_id, t - 3 AS t FROM bars WHERE t % 11 < 2 UNION ALL SELECT series_id, t FROM bars WHERE t % 40 = 8), c AS (SELECT series_id, t, count(*) AS times FROM tr GROUP BY 1, 2) SELECT c.series_id, t, times, n FROM c LEFT JOIN n USING (series_id) WHERE n IS NULL OR t < 1 OR t > n OR times > 1")
def truth_validation(spark, sf_dir):
    bars = eval_bars(spark, sf_dir)
    truth = bars.where("t % 11 < 2").select(SERIES, (F.col("t") - 3).alias("t")).unionByName(bars.where("t % 40 = 8").select(SERIES, "t"))
    return clean.invalid_truth(truth, bars.groupBy(SERIES).agg(F.count("*").alias("n"))).select(SERIES, "t", "times", "n")


@query("event_validation", "SELECT event_id::VARCHAR AS id, event_type, ts AS \"start\", ts + to_days(CAST(user_id % 3 - 1 AS INTEGER)) AS \"end\" FROM events WHERE user_id % 3 = 0")
def event_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), "event_type", F.col("ts").cast("timestamp_ntz").alias("start"), F.expr("cast(ts as timestamp_ntz) + make_dt_interval(cast(user_id % 3 - 1 as int))").alias("end"))
    return clean.invalid_events(rows)


@query("sim_real_gap", f"WITH {OBS}, r AS (SELECT series_id, avg(y) AS m, var_pop(y) AS v FROM obs WHERE t % 2 = 0 GROUP BY 1), s AS (SELECT series_id, avg(y) AS m, var_pop(y) AS v FROM obs WHERE t % 2 = 1 GROUP BY 1) SELECT r.series_id, 'mean' AS metric, {R('s.m')} AS sim, {R('r.m')} AS real, {R('r.m - s.m')} AS gap FROM r JOIN s USING (series_id) UNION ALL SELECT r.series_id, 'variance', {R('s.v')}, {R('r.v')}, {R('r.v - s.v')} FROM r JOIN s USING (series_id)")
def sim_real_gap(spark, sf_dir):
    rows = obs(spark, sf_dir)
    real, sim = (features.summary(rows.where(F.col("t") % 2 == i)) for i in (0, 1))
    return neat(evaluate.sim_real_gap(sim, real, ["mean", "variance"]))


@query("comparison_table", f"WITH {OBS} SELECT series_id, 'even' AS run, count(*)::BIGINT AS n, {R('avg(y)')} AS mean, NULL::DOUBLE AS max FROM obs WHERE t % 2 = 0 GROUP BY 1 UNION ALL SELECT series_id, 'odd', count(*)::BIGINT, NULL, {R('max(y)')} FROM obs WHERE t % 2 = 1 GROUP BY 1")
def comparison_table(spark, sf_dir):
    rows = obs(spark, sf_dir)
    even = features.summary(rows.where("t % 2 = 0")).select(SERIES, F.lit("even").alias("run"), "n", "mean")
    odd = features.summary(rows.where("t % 2 = 1")).select(SERIES, F.lit("odd").alias("run"), "n", "max")
    return neat(evaluate.comparison_table([even, odd]))


@query("scenarios", "SELECT scenario, regime::BIGINT AS regime, mean::DOUBLE AS mean, variance::DOUBLE AS variance, stay::DOUBLE AS stay FROM (VALUES ('scenario_calibrated', 0, 0.0002, 0.0001, 0.96), ('scenario_calibrated', 1, -0.0001, 0.0004, 0.88), ('persistent_states', 0, 0.0001, 0.00008, 0.975), ('persistent_states', 1, -0.0001, 0.00032, 0.933), ('shock_contaminated', 0, 0.0002, 0.0001, 0.96), ('shock_contaminated', 1, -0.0005, 0.0016, 0.88), ('three_regimes', 0, 0.0003, 0.00009, 0.971), ('three_regimes', 1, 0.0, 0.00018, 0.930), ('three_regimes', 2, -0.0002, 0.0004, 0.857)) AS t(scenario, regime, mean, variance, stay)")
def scenarios(spark, sf_dir):
    rows = [(n, j, float(p.means[j]), float(p.variances[j]), float(p.transition[j][j])) for n, p in hmm.SCENARIOS.items() for j in range(p.k)]
    return spark.createDataFrame(rows, "scenario string, regime bigint, mean double, variance double, stay double")


@query("model_grid", "SELECT k::BIGINT AS k, f AS family, w::BIGINT AS \"window\" FROM (SELECT unnest([2, 3]) AS k), (SELECT unnest(['log_return', 'abs_return', 'squared_return', 'rolling_vol', 'rolling_vol']) AS f, unnest([5, 5, 5, 5, 20]) AS w)")
def model_grid(spark, sf_dir):
    return spark.createDataFrame([(k, f.family, f.window) for k, f in search.model_grid()], "k bigint, family string, window bigint")


@query("registered_experiments", "SELECT label, mode, detector, threshold::DOUBLE AS threshold, required::BIGINT AS required, cooldown::BIGINT AS cooldown FROM (VALUES ('hard_switch', 'synthetic', 'hard_switch', 0.5, 2, 5), ('posterior_transition', 'synthetic', 'leave_previous', 0.3, 2, 5), ('surprise', 'synthetic', 'surprise', 2.5, 2, 5), ('posterior_transition_tv', 'synthetic', 'total_variation', 0.3, 2, 5), ('hard_switch_shock', 'synthetic', 'hard_switch', 0.5, 2, 5), ('hard_switch_frozen', 'synthetic', 'hard_switch', 0.5, 2, 5), ('hard_switch_multi_start', 'synthetic', 'hard_switch', 0.5, 2, 5), ('surprise_ema', 'synthetic', 'surprise', 2.5, 2, 5), ('squared_return_surprise', 'synthetic', 'surprise', 2.5, 2, 5), ('real_spy_daily_hard_switch', 'real', 'hard_switch', 0.55, 2, 5), ('real_wti_daily_surprise', 'real', 'surprise', 3.0, 2, 10), ('real_spy_intraday_hard_switch', 'real', 'hard_switch', 0.55, 3, 10), ('simreal_spy_daily_hard_switch', 'sim_to_real', 'hard_switch', 0.55, 2, 5), ('simreal_spy_daily_abs_return_k3', 'sim_to_real', 'hard_switch', 0.55, 2, 5), ('simreal_wti_daily_abs_return_k3', 'sim_to_real', 'hard_switch', 0.55, 2, 5), ('simreal_gold_daily_abs_return_k3', 'sim_to_real', 'hard_switch', 0.55, 2, 5)) AS t(label, mode, detector, threshold, required, cooldown)")
def registered_experiments(spark, sf_dir):
    from .plans.registry import registry

    rows = [(e.label, e.mode, e.detector.kind, float(e.detector.threshold), e.detector.required, e.detector.cooldown) for e in registry().values()]
    return spark.createDataFrame(rows, "label string, mode string, detector string, threshold double, required bigint, cooldown bigint")


@query("run_ids")
def run_ids(spark, sf_dir):
    """The names of the registered experiments' runs, which end in a hash of their configurations."""
    from .plans.registry import registry

    return spark.createDataFrame([(e.label, e.run_id()) for e in registry().values()], "label string, run_id string")


@query("online_stream", f"{ALARMS} SELECT f.series_id, f.t, f.ts, {R('f0')} AS p0, {R('f1')} AS p1, {R('log_c')} AS log_c, score, ready, alarm FROM flt f JOIN scored s ON s.series_id = f.series_id AND s.t = f.t JOIN per p ON p.series_id = f.series_id AND p.t = f.t")
def online_stream(spark, sf_dir):
    """The flagship's steps by Structured Streaming, in several micro-batches."""
    from .streaming.online import replay

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidegate-")
    rows = replay(obs(spark, sf_dir), MODEL, DET, f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}", 3)
    return neat(rows.select(SERIES, "t", "ts", *two("filtered", "p"), "log_c", "score", "ready", "alarm"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the frozen model over the intraday series: probabilities, density, score and alarm."""
    rows = detect.online_run(obs(spark, sf_dir), MODEL, DET)
    return rows.select(SERIES, "t", "ts", *two("filtered", "p"), "log_c", "score", "alarm")


query("flagship", f"{ALARMS} SELECT f.series_id, f.t, f.ts, {R('f0')} AS p0, {R('f1')} AS p1, {R('log_c')} AS log_c, score, alarm FROM flt f JOIN scored s ON s.series_id = f.series_id AND s.t = f.t JOIN per p ON p.series_id = f.series_id AND p.t = f.t")(lambda spark, sf_dir: neat(flagship(spark, sf_dir)))
