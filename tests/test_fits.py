"""The fitted queries, which have no SQL, against plain loops: a filter, a smoother, EM to convergence and the search, step by step."""

import math

import numpy as np
import pytest

from tidegate.operators import features, search
from tidegate.queries import QUERIES, daily, numbered_bars, obs

SF = "/root/testdata/sf0.001"


def plain_filter(p, y, move_first=False):
    pi, a, m, v = p
    now, out, predicted, logs = (pi @ a if move_first else pi), [], [], []
    for x in y:
        u = now * np.exp(-0.5 * (x - m) ** 2 / v) / np.sqrt(2 * math.pi * v)
        predicted.append(now)
        out.append(u / u.sum())
        logs.append(math.log(u.sum()))
        now = out[-1] @ a
    return np.array(predicted), np.array(out), np.array(logs)


def plain_em(y, k, tol=1e-6, most=1000):
    order, size = np.sort(y), len(y) // k
    parts = [order[j * size : len(y) if j == k - 1 else (j + 1) * size] for j in range(k)]
    a = np.full((k, k), 0.1 / (k - 1)) + np.eye(k) * (0.9 - 0.1 / (k - 1))
    p = (np.full(k, 1 / k), a, np.array([x.mean() for x in parts]), np.array([max(x.var(), 1e-6) for x in parts]))
    history = []
    while True:
        predicted, filtered, logs = plain_filter(p, y)
        history.append(logs.sum())
        if len(history) > 1 and abs(history[-1] - history[-2]) < tol or len(history) > most:
            return p, history
        smooth, moves = [filtered[-1]], np.zeros((k, k))
        for t in range(len(y) - 2, -1, -1):
            pair = filtered[t][:, None] * p[1] * (smooth[0] / predicted[t + 1])[None]
            moves += pair
            smooth.insert(0, pair.sum(1))
        s = np.array(smooth)
        m = s.T @ y / s.sum(0)
        v = np.array([max((s[:, j] * (y - m[j]) ** 2).sum() / s[:, j].sum(), 1e-6) for j in range(k)])
        p = (s[0], moves / moves.sum(1, keepdims=True), m, v)


def series(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["series_id"], r["t"])):
        out.setdefault(r["series_id"], []).append(r["y"])
    return {s: np.array(y) for s, y in out.items()}


@pytest.fixture(scope="module")
def plain(spark):
    return {s: plain_em(y, 2) for s, y in series(obs(spark, SF)).items()}


def test_fits_equal_plain_em(spark, plain):
    rows = {r["series_id"]: r for r in QUERIES["em_fit"](spark, SF).collect()}
    assert set(rows) == set(plain)
    for s, ((pi, a, m, v), history) in plain.items():
        r, by_mean = rows[s], np.argsort(m)
        assert r["converged"] and r["n_iter"] == len(history) - 1 and r["log_likelihood"] == pytest.approx(history[-1], abs=1e-6)
        np.testing.assert_allclose(r["pi"], pi[by_mean], atol=1e-6)
        np.testing.assert_allclose(r["transition"], a[np.ix_(by_mean, by_mean)], atol=1e-6)
        np.testing.assert_allclose([r["means"], r["variances"]], [m[by_mean], v[by_mean]], atol=1e-6)


def test_convergence_and_validity_equal_plain_em(spark, plain):
    rows = {r["series_id"]: r for r in QUERIES["convergence"](spark, SF).collect()}
    for s, (_, history) in plain.items():
        steps = np.diff(history)
        assert rows[s]["gain"] == pytest.approx(history[-1] - history[0], abs=1e-6) and rows[s]["min_delta"] == pytest.approx(steps.min(), abs=1e-6)
        assert rows[s]["monotone"] == (steps.min() >= -1e-8)
    assert sorted(r["series_id"] for r in QUERIES["param_validity"](spark, SF).collect()) == sorted(plain)


def plain_alarms(crossed, required, cooldown):
    found, count, rest = [], 0, 0
    for t, c in enumerate(crossed, 1):
        if rest:
            rest, count = rest - 1, 0
        elif not c:
            count = 0
        elif count + 1 >= required:
            found.append(t)
            count, rest = 0, cooldown
        else:
            count += 1
    return found


def plain_score(truth, alarms, window):
    last, hits = 0, 0
    for tau in truth:
        hit = next((a for a in alarms if a >= tau and a > last), None)
        if hit is not None and hit < tau + window:
            last, hits = hit, hits + 1
    return 0.5 * (hits / len(truth) if truth else 0) + 0.5 * (hits / len(alarms) if alarms else 0)


def test_search_equals_plain_loops(spark):
    prices = daily(spark, SF)
    truth = numbered_bars(prices).where("t % 37 = 5").select("series_id", "t")
    models = [search.model_grid()[i] for i in (0, 1, 3, 6)]
    grid = search.Grid((1.0, 2.0), (1, 2), (0, 5))
    got = {}
    for r in search.search_models(prices, truth, models, "surprise", grid, tol=1e-3, max_iter=8).collect():
        got.setdefault(r["series_id"], {})[r["point"]] = r
    taus = {}
    for r in truth.collect():
        taus.setdefault(r["series_id"], []).append(r["t"])
    expected = {}
    for i, (k, f) in enumerate(models):
        for s, y in series(features.stream(prices, f)).items():
            p, _ = plain_em(y, k, 1e-3, 8)
            surprise = -plain_filter(p, y, True)[2]
            for j, (threshold, required, cooldown) in enumerate(grid.points()):
                alarms = plain_alarms(surprise >= threshold, required, cooldown)
                expected.setdefault(s, {})[i * 8 + j] = (i, k, alarms, plain_score(sorted(taus.get(s, [])), alarms, 20))
    assert {s: set(x) for s, x in got.items()} == {s: set(x) for s, x in expected.items()} and len(expected) == 5
    for s, points in expected.items():
        for point, (i, k, alarms, score) in points.items():
            r = got[s][point]
            assert (r["model"], r["k"], list(r["alarms"])) == (i, k, alarms) and r["score"] == pytest.approx(score)
        ranked = sorted(points, key=lambda x: (-got[s][x]["score"], x))
        assert [got[s][x]["rank"] for x in ranked] == list(range(1, len(points) + 1))
