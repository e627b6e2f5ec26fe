import datetime as dt
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate import queries as Q
from tidegate.functions import kernels as K
from tidegate.operators import calibrate, clean, detect, evaluate, features, hmm, scan
from tidegate.sources import files, store, vendor
from tidegate.streaming import online

P = K.Params([0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], [-3.0, 3.0], [1.0, 1.0])
SF = "/root/testdata/sf0.001"


def bars(spark, rows):
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")


def at(minute, day=2):
    return dt.datetime(2024, 1, day, 9, 30) + dt.timedelta(minutes=minute)


def test_gap_of_more_than_three_bars(spark):
    df = bars(spark, [("a", at(0), 1.0), ("a", at(30), 1.0), ("a", at(35), 1.0)])
    assert [tuple(r) for r in clean.gaps(df, 5).collect()] == [("a", at(0), at(30))]


def test_rolling_deviation(spark):
    value, rows = 100.0, [("a", at(0), 100.0)]
    for i, r in enumerate((0.01, 0.02, 0.03), 1):
        value *= np.exp(r)
        rows.append(("a", at(i), float(value)))
    got = features.rolling(bars(spark, rows), "rolling_vol", 3).collect()
    assert len(got) == 1 and got[0]["y"] == pytest.approx((2e-4 / 3) ** 0.5)


def test_undefined_returns_are_dropped_but_stay_the_row_before(spark):
    df = bars(spark, [("a", at(i), v) for i, v in enumerate((1.0, 0.0, 2.0, 4.0))])
    got = features.returns(df).collect()
    assert [r["ts"] for r in got] == [at(3)] and got[0]["y"] == pytest.approx(np.log(2))


def test_empty_series_give_empty_results(spark):
    df = bars(spark, [])
    obs = features.stream(df, features.Feature())
    assert obs.count() == 0 and hmm.filter_rows(obs, P).count() == 0 and clean.quality_report(df.withColumn("ord", F.lit(1)), 5).count() == 0


@pytest.fixture(scope="module")
def observed(spark):
    rows = []
    for s in range(3):
        _, y = K.simulate(P, 300, np.random.default_rng(s))
        rows += [(f"s{s}", i + 1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, t bigint, ts timestamp_ntz, y double")


def test_blocked_filter_equals_the_whole_one(observed):
    for move in (True, False):
        key = lambda r: (r["series_id"], r["t"])
        a = sorted(hmm.filter_rows(observed, P, move).collect(), key=key)
        b = sorted(scan.blocked_filter(observed, P, move, 37).collect(), key=key)
        np.testing.assert_allclose([r["filtered"] for r in a], [r["filtered"] for r in b], atol=1e-12)
        np.testing.assert_allclose([r["log_c"] for r in a], [r["log_c"] for r in b], atol=1e-9)


@pytest.mark.parametrize("d", [K.Detector("hard_switch", 0.5, 2, 5), K.Detector("leave_previous", 0.3, 1, 3), K.Detector("total_variation", 0.3), K.Detector("surprise", 2.0, 1, 2, 0.3), K.Detector("surprise", 3.0)])
def test_session_equals_batch(observed, d):
    rows = sorted(observed.where("series_id = 's1'").collect(), key=lambda r: r["t"])
    got = online.Session(P, d).run([r["y"] for r in rows])
    batch = sorted(detect.alarms(hmm.filter_rows(observed.where("series_id = 's1'"), P, True), d).collect(), key=lambda r: r["t"])
    assert [g["alarm"] for g in got] == [b["alarm"] for b in batch]
    np.testing.assert_allclose([g["score"] for g in got], [b["score"] for b in batch], atol=1e-9)


def test_stream_equals_batch(spark, observed, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        observed.where(F.col("t").between(1 + 100 * i, 100 + 100 * i)).select("series_id", "ts", "y").coalesce(1).write.mode("append").parquet(source)
    d = K.Detector("hard_switch", 0.5, 2, 5)
    stream = spark.readStream.schema("series_id string, ts timestamp_ntz, y double").option("maxFilesPerTrigger", 1).parquet(source)
    query = online.online(stream, P, d).writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {(r["series_id"], r["t"]): r["alarm"] for r in spark.table("steps").collect()}
    assert got == {(r["series_id"], r["t"]): r["alarm"] for r in detect.alarms(hmm.filter_rows(observed, P, True), d).collect()}


def test_rows_of_one_instant_are_steps_of_their_own(spark, observed, tmp_path):
    d = K.Detector("surprise", 2.0, 1, 2, 0.3)
    tied = observed.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    got = {(r["series_id"], r["t"]): r for r in online.replay(tied, P, d, f"file://{tmp_path}", 3).collect()}
    want = {(r["series_id"], r["t"]): r for r in detect.alarms(hmm.filter_rows(tied, P, True), d).collect()}
    assert set(got) == set(want) and len(got) == 900
    assert [got[k]["alarm"] for k in sorted(got)] == [want[k]["alarm"] for k in sorted(got)]
    np.testing.assert_allclose([got[k]["score"] for k in sorted(got)], [want[k]["score"] for k in sorted(got)], atol=1e-9)


def test_sessions_start_anew_and_late_rows_go(spark):
    class Handle:
        kept = None
        exists = lambda self: self.kept is not None
        get = lambda self: self.kept
        getValueState = lambda self, name, kind: self

        def update(self, kept):
            self.kept = kept

    rng, d = np.random.default_rng(5), K.Detector("leave_previous", 0.3, 1, 3)
    ts = [at(i, day) for day in (2, 3) for i in range(5)]
    rows = pd.DataFrame({"ts": ts, "y": rng.standard_normal(10) * 3})
    whole, cut = (online.OnlineProcessor(P, d, True) for _ in range(2))
    [p.init(Handle()) for p in (whole, cut)]
    one = [r for x in whole.handleInputRows(("a",), iter([rows]), None) for r in x.to_dict("records")]
    # the second call sees two rows again that are late by then
    two = [r for part in (rows[:7], rows.drop(index=[2, 3, 4, 5, 6])) for x in cut.handleInputRows(("a",), iter([part]), None) for r in x.to_dict("records")]
    assert [r["t"] for r in one] == [1, 2, 3, 4, 5, 1, 2, 3, 4, 5] == [r["t"] for r in two]
    assert [r["alarm"] for r in one] == [r["alarm"] for r in two]
    session = online.Session(P, d)
    assert [r["score"] for r in one[:5]] == pytest.approx([r["score"] for r in session.run(rows["y"][:5])])


def test_route_a_point(spark):
    rows = [("a", i, dt.datetime(2024, 1, i), 1.0) for i in range(1, 11)]
    b = spark.createDataFrame(rows, "series_id string, t bigint, ts timestamp_ntz, value double")
    alarms = spark.createDataFrame([("a", 4), ("a", 9)], "series_id string, t bigint")
    events = spark.createDataFrame([("a", "e", "point", dt.datetime(2024, 1, 5), None)], "series_id string, id string, kind string, start timestamp_ntz, end timestamp_ntz")
    got = evaluate.route_a(b, alarms, events, 1, 1).collect()[0]
    assert (got["event_coverage"], got["alarm_relevance"], got["min_delay_bars"]) == (1.0, 0.5, -1)


def test_route_b_segments(spark):
    rows = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate((1.0, 1.0, 1.0, 10.0, 10.0))], "series_id string, t bigint, y double")
    alarms = spark.createDataFrame([("a", 4), ("a", 1)], "series_id string, t bigint")
    got = sorted((r["start"], r["end"]) for r in evaluate.segment_summary(evaluate.segments(rows, alarms), 2).collect())
    assert got == [(1, 3), (4, 5)]


def test_calibration_policies():
    s = {"mean": 0.1, "variance": 4.0, "std_dev": 2.0, "q05": -2.0, "q50": 0.0, "q95": 3.0, "low_episode_mean": 10.0, "high_episode_mean": 1.0}
    assert calibrate.map_means(s, calibrate.Mapping()) == [-0.5, 0.5]
    assert calibrate.map_variances(s, calibrate.Mapping()) == pytest.approx([(2 / 1.64485) ** 2, (3 / 1.64485) ** 2])
    low, high = calibrate.map_variances(s, calibrate.Mapping(min_ratio=3.0))
    assert (high / low) ** 0.5 == pytest.approx(3.0)
    np.testing.assert_allclose(calibrate.durations_to_rows([10, 5]), [[0.9, 0.1], [0.2, 0.8]])
    assert calibrate.infer_durations(s, 2) == [10.0, 2.0]
    with pytest.raises(ValueError):
        calibrate.Mapping(k=1).check()


def test_vendor_payloads(spark, tmp_path):
    (tmp_path / "wti_daily.json").write_text(json.dumps({"name": "Crude", "interval": "daily", "unit": "dollars", "data": [{"date": "2024-01-02", "value": "70.5"}, {"date": "2024-01-01", "value": "."}]}))
    for m, rows in (("2024-01", {"2024-01-02 10:00:00": {"4. close": "5.5"}, "2023-12-29 10:00:00": {"4. close": "1"}}), ("2024-02", {"2024-02-01 10:00:00": {"4. close": "6"}, "bad": {"4. close": "x"}})):
        (tmp_path / f"spy_15min_{m}.json").write_text(json.dumps({"Meta Data": {"2. Symbol": "SPY"}, "Time Series (15min)": rows}))
    spark.dataSource.register(vendor.VendorSource)
    one = spark.read.format("vendor").option("path", str(tmp_path)).option("symbol", "wti").load()
    assert [(r["name"], r["ts"], r["value"]) for r in vendor.decode(one).collect()] == [("Crude", dt.datetime(2024, 1, 2), 70.5)]
    many = spark.read.format("vendor").options(path=str(tmp_path), symbol="spy", interval="15min", **{"from": "2023-12-01", "until": "2024-02-10"}).load()
    got = sorted((r["ts"], r["value"], r["name"]) for r in vendor.decode(many).collect())
    assert got == [(dt.datetime(2024, 1, 2, 10), 5.5, "SPY Adjusted Close"), (dt.datetime(2024, 2, 1, 10), 6.0, "SPY Adjusted Close")]


def test_names_and_limits():
    assert vendor.parse_series("Natural-Gas:w") == ("natural_gas", "weekly") and vendor.instrument("XAU") == "gold"
    with pytest.raises(ValueError):
        vendor.parse_series("wheat:daily")
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = vendor.RateLimiter(60, lambda: now[0], sleep)
    for _ in range(62):
        limiter.acquire()
    assert sum(slept) == pytest.approx(2.0)


def test_store_replaces_one_series(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.status().count() == 0

    def rows(symbol, value):
        return spark.createDataFrame([(symbol, "daily", symbol, "USD", dt.datetime(2024, 1, d), value) for d in (1, 2, 2)], vendor.SERIES_SCHEMA)

    def fetch(symbol, how):
        if symbol == "brent":
            raise RuntimeError("down")
        return rows(symbol, 1.0)

    got = s.ingest([("wti", "daily"), ("brent", "daily"), ("gold", "daily")], fetch, "2024-02-01 00:00:00")
    assert got == {("wti", "daily"): "stored", ("brent", "daily"): "failed: down", ("gold", "daily"): "stored"}
    s.replace(rows("wti", 9.0), "2024-02-02 00:00:00")
    assert [r["value"] for r in s.load("wti", "daily").collect()] == [9.0, 9.0] and [r["value"] for r in s.load("gold", "daily").collect()] == [1.0, 1.0]
    assert s.ingest([("wti", "daily")], fetch, "2024-02-03 00:00:00") == {("wti", "daily"): "cached"}


def test_files(spark, tmp_path):
    path = str(tmp_path / "p.json")
    files.write_params(path, P)
    np.testing.assert_allclose(files.read_params(path).transition, P.transition)
    (tmp_path / "s.toml").write_text('[vendor]\napi_key = "k"\n[store]\npath = "x"\n[ingest]\nseries = ["wti:d", {commodity = "gold", interval = "monthly"}]\n')
    assert files.read_settings(str(tmp_path / "s.toml")).series == [("wti", "daily"), ("gold", "monthly")]
    (tmp_path / "e.json").write_text(json.dumps([{"id": "a", "event_type": "x", "label": "l", "asset_scope": None, "anchor": {"Point": {"at": "2024-01-02T00:00:00"}}}, {"id": "b", "event_type": "x", "label": "l", "asset_scope": "W", "anchor": {"Window": {"start": "2024-01-02T00:00:00", "end": "2024-01-05T00:00:00"}}}]))
    assert sorted((r["id"], r["kind"], r["end"]) for r in files.read_events(spark, str(tmp_path / "e.json"), "a").collect()) == [("a", "point", None), ("b", "window", dt.datetime(2024, 1, 5))]
    table = files.MetricsTable([{"run": "a_b", "coverage": 0.12345, "delay_mean": 1.234}, {"run": "c", "coverage": None, "delay_mean": float("nan")}])
    assert "| a_b | 0.123 | 1.23 |" in table.to_markdown() and "a\\_b & 0.123 & 1.23" in table.to_latex() and "c & -- & --" in table.to_latex() and table.to_csv().endswith("c,,\n")


def test_diagnosis_tells_a_sound_fit_from_a_suspect_one(spark):
    start = dt.datetime(2024, 1, 1)
    obs = spark.createDataFrame([(s, t, start + dt.timedelta(days=t), float((t * 7) % 5 - 2) * (1.0 if s == "good" else 0.001)) for s in ("good", "bad") for t in range(1, 41)], "series_id string, t bigint, ts timestamp_ntz, y double")
    fit = ([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]])
    fits = spark.createDataFrame([("good", 0, 2, *fit, [-1.0, 1.0], [1.0, 1.0], -50.0, 3, True, [-60.0, -52.0, -50.0]), ("bad", 0, 2, *fit, [0.0, 0.001], [1e-5, 1e-5], -50.0, 3, False, [-60.0, -49.0, -50.0])], hmm.FIT)
    got = {r["series_id"]: r for r in hmm.diagnose(obs, fits).collect()}
    assert set(got) == {"good", "bad"}
    good, bad = got["good"], got["bad"]
    assert good["valid"] and good["trustworthy"] and good["monotone"] and good["warnings"] == []
    assert sum(r["occupancy"] for r in good["regimes"]) == pytest.approx(1) and sum(r["hard_count"] for r in good["regimes"]) == 40
    assert [round(r["expected_duration"], 6) for r in good["regimes"]] == [10.0, 5.0]
    assert [(w["kind"], w["regime"]) for w in bad["warnings"]] == [("em_non_monotonicity", None), ("near_zero_variance", 0), ("near_zero_variance", 1)]
    assert bad["trustworthy"] and not bad["monotone"] and bad["largest_drop"] == 1.0


def test_store_of_days_becomes_one_of_timestamps(spark, tmp_path):
    path = str(tmp_path / "store")
    s = store.Store(spark, path)
    assert s.prepare() == ["prices: made", "meta: made"] and s.prepare() == [] and s.status().count() == 0
    old = str(tmp_path / "old")
    day, now = dt.date(2024, 1, 2), dt.datetime(2024, 2, 1)
    for name, rows, ddl in (("prices", [(day, 1.5, now, "wti", "daily"), (day, 2.5, now, "spy", "daily")], "ts date, value double, fetched_at timestamp_ntz, symbol string, interval string"), ("meta", [("W", "USD", "wti", "daily")], store.META)):
        spark.createDataFrame(rows, ddl).write.partitionBy("symbol", "interval").parquet(f"{old}/{name}")
    s = store.Store(spark, old)
    assert s.prepare() == ["prices: ts changed"] and s.prepare() == []
    assert [tuple(r) for r in s.load("wti", "daily").collect()] == [(dt.datetime(2024, 1, 2), 1.5)] and s.status().count() == 2
    os.rename(f"{old}/prices", f"{old}/prices.new")  # ended after the old table went
    assert s.prepare() == ["prices: finished"] and s.status().count() == 2
    s.replace(spark.createDataFrame([("wti", "daily", "W", "USD", dt.datetime(2024, 3, 1), 9.0)], vendor.SERIES_SCHEMA), "2024-03-02 00:00:00")
    assert s.load("wti", "daily").first()["value"] == 9.0 and s.prepare() == []


def test_regimes_equal_the_summary_of_smoothed_rows(observed):
    key = lambda r: (r["series_id"], r["regime"])
    got, want = (sorted(df.collect(), key=key) for df in (hmm.regimes(observed, P), hmm.regime_summary(hmm.smooth_rows(observed, P), P)))
    assert [(*key(r), r["hard_count"]) for r in got] == [(*key(r), r["hard_count"]) for r in want] and len(got) == 6
    for c in ("occupancy", "self_prob", "expected_duration", "mean", "variance"):
        np.testing.assert_allclose([r[c] for r in got], [r[c] for r in want], atol=1e-12)


def test_warnings_of_fits_are_one_for_each_start_and_series(spark):
    p = ([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [-1.0, 1.0], [1.0, 1.0])
    rows = [("a", 0, 2, *p, -50.0, 2, True, [-60.0, -49.0, -50.0]), ("a", 1, 2, *p, -48.0, 1, True, [-47.5, -48.0]), ("b", 0, 2, *p, -5.0, 0, False, [-5.0])]
    none = spark.createDataFrame([], "series_id string, regime int, occupancy double, self_prob double, variance double")
    got = sorted(tuple(r) for r in hmm.warnings(spark.createDataFrame(rows, hmm.FIT), none).collect())
    assert got == [("a", "em_non_monotonicity", None, 0.5), ("a", "em_non_monotonicity", None, 1.0), ("a", "unstable_across_starts", None, 2.0)]


def test_warnings_are_of_the_fitted_regimes(spark):
    start = dt.datetime(2024, 1, 1)
    obs = spark.createDataFrame([(s, t, start + dt.timedelta(days=t), float((t * 7) % 5 - 2)) for s in ("a", "b", "c") for t in range(40, 0, -1)], "series_id string, t bigint, ts timestamp_ntz, y double")
    sound, suspect = ([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [-1.0, 1.0], [1.0, 1.0]), ([1.0, 0.0], [[1.0, 0.0], [0.5, 0.5]], [0.0, 50.0], [2.0, 1e-5])
    fits = [("a", 0, 2, *sound, -50.0, 2, True, [-60.0, -50.0]), ("a", 1, 2, *suspect, -48.0, 2, True, [-47.5, -48.0]), ("b", 0, 2, *suspect, -50.5, 1, True, [-60.0, -50.5]), ("b", 1, 2, *sound, -50.0, 1, True, [-60.0, -50.0])]
    fits = spark.createDataFrame(fits, hmm.FIT)
    got = sorted(tuple(r) for r in hmm.fit_warnings(obs, fits).collect())
    assert [r[:3] for r in got] == [("a", "em_non_monotonicity", None), ("a", "near_zero_variance", 1), ("a", "nearly_unused_regime", 1), ("a", "suspicious_persistence", 0), ("a", "unstable_across_starts", None)]
    assert [r[3] for r in got] == [0.5, 1e-5, pytest.approx(0.0, abs=1e-9), 1.0, 2.0]
    assert got == sorted(tuple(r) for r in hmm.warnings(fits, hmm.regimes(obs.where("series_id <> 'c'"), hmm.best_fit(fits))).collect())


def test_diagnostic_warnings_hang_on_the_fits(spark, monkeypatch):
    """A fit with a regime that is never left is told, whatever the fixed model is like."""
    fixed = {"k": 2, "pi": [1.0, 0.0], "transition": [[1.0, 0.0], [0.5, 0.5]], "means": [0.0, 50.0], "variances": [1.0, 1.0]}
    made = lambda spark, sf, *_: Q.obs(spark, sf).groupBy("series_id").agg(F.lit(0).alias("start"), *[F.lit(v).alias(c) for c, v in fixed.items()], F.lit(-5.0).alias("log_likelihood"), F.array(F.lit(-6.0), F.lit(-5.0)).alias("history"))
    monkeypatch.setattr(Q, "fits", made)
    got = sorted((r["series_id"], r["kind"], r["regime"]) for r in Q.QUERIES["diagnostic_warnings"](spark, SF).collect())
    series = sorted(r[0] for r in Q.obs(spark, SF).select("series_id").distinct().collect())
    assert got == sorted((s, k, j) for s in series for k, j in (("nearly_unused_regime", 1), ("suspicious_persistence", 0)))
