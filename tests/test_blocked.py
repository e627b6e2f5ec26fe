"""Blocked scans against the kernels that hold a whole series, and the cost of as-of lookups."""

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.functions import kernels as K
from tidegate.operators import detect, evaluate, hmm, scan

P = K.Params([0.3, 0.7], [[0.95, 0.05], [0.1, 0.9]], [-1.0, 1.0], [1.0, 2.0])


def series(spark, lengths, seed=3):
    parts = []
    for i, n in enumerate(lengths):
        _, y = K.simulate(P, n, np.random.default_rng(seed + i))
        parts.append(pd.DataFrame({"series_id": f"s{i}", "t": np.arange(1, n + 1), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "min"), "y": y}))
    return spark.createDataFrame(pd.concat(parts), "series_id string, t bigint, ts timestamp_ntz, y double").repartition(4)


def rows(df, *columns):
    return df.select("series_id", "t", *columns).orderBy("series_id", "t").toPandas()


@pytest.mark.parametrize(("block", "lengths"), [(1, (1, 2, 5)), (16, (1, 32, 50)), (1000, (3, 64))])
def test_blocks_give_what_whole_series_give(spark, block, lengths):
    obs = series(spark, lengths)
    a, b = rows(scan.blocked_smoother(obs, P, block), "smoothed"), rows(hmm.smooth_rows(obs, P), "smoothed")
    assert (a[["series_id", "t"]] == b[["series_id", "t"]]).all().all() and np.allclose(a["smoothed"].tolist(), b["smoothed"].tolist())
    a, b = (x.orderBy("series_id").collect() for x in (scan.blocked_em_step(obs.where("series_id > 's0'"), P, block), hmm.em_step(obs.where("series_id > 's0'"), P)))
    for x, y in zip(a, b, strict=True):
        assert all(np.allclose(x[c], y[c]) for c in ("pi", "transition", "means", "variances", "log_likelihood"))
    posterior = hmm.filter_rows(obs, P, True).cache()
    for d in (K.Detector("hard_switch", 0.5, 2, 5), K.Detector("leave_previous", 0.2, 3, 0), K.Detector("total_variation", 0.1, 1, 2), K.Detector("surprise", 1.5, 2, 3), K.Detector("surprise", 0.2, 2, 4, 0.3)):
        names = ("ts", "score", "ready", "alarm", "dominant", "dominant_before")
        a, b = rows(scan.blocked_alarms(posterior, d, block), *names), rows(detect.alarms(posterior, d), *names)
        assert (a.drop(columns="score").astype(str) == b.drop(columns="score").astype(str)).all().all() and np.allclose(a["score"], b["score"]), d
    posterior.unpersist()


def test_long_series_in_blocks(spark):
    obs = series(spark, (50_000,))
    a, b = rows(scan.blocked_smoother(obs, P, 8192), "smoothed"), rows(hmm.smooth_rows(obs, P), "smoothed")
    got = np.array(a["smoothed"].tolist())
    assert np.allclose(got, b["smoothed"].tolist()) and np.abs(got.sum(1) - 1).max() < 1e-9


def test_as_of_lookups_are_linear_and_break_ties_alike(spark):
    def seconds(n):
        bars = spark.range(1, n + 1).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.timestamp_seconds(F.col("id") * 2).cast("timestamp_ntz").alias("ts"))
        points = spark.range(n).select(F.lit("s").alias("series_id"), F.timestamp_seconds(F.col("id") * 2 + 1).cast("timestamp_ntz").alias("at"))
        began = time.perf_counter()
        out = {x: evaluate.as_of(points, bars, x).agg(F.sum("index"), F.count("index")).first() for x in (True, False)}
        assert out[True] == (n * (n + 1) // 2, n) and out[False] == ((n - 1) * n // 2, n - 1)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(160_000) < 6 * max(seconds(40_000), 1.0)
    at = lambda x: datetime(2024, 1, 1) + timedelta(seconds=x)
    bars = spark.createDataFrame([("s", 1, at(0)), ("s", 2, at(5)), ("s", 3, at(5)), ("s", 4, at(9))], "series_id string, t bigint, ts timestamp_ntz")
    points = spark.createDataFrame([("s", at(5)), ("s", at(10)), ("s", at(-1)), ("z", at(1))], "series_id string, at timestamp_ntz")
    found = lambda forward: {(r["series_id"], r["at"].second): r["index"] for r in evaluate.as_of(points, bars, forward).collect()}
    assert found(True) == {("s", 5): 2, ("s", 10): None, ("s", 59): 1, ("z", 1): None}
    assert found(False) == {("s", 5): 3, ("s", 10): 4, ("s", 59): None, ("z", 1): None}
