import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.functions import kernels as K

P = K.Params([0.5, 0.5], [[0.95, 0.05], [0.1, 0.9]], [-1.0, 1.5], [1.0, 0.5])


def plain_filter(p, y, move_first=False):
    now = p.pi @ p.transition if move_first else p.pi
    out, logs = [], []
    for x in y:
        d = np.exp(-0.5 * (x - p.means) ** 2 / p.variances) / np.sqrt(2 * np.pi * p.variances)
        u = now * d
        logs.append(math.log(u.sum()))
        out.append(u / u.sum())
        now = out[-1] @ p.transition
    return np.array(out), np.array(logs)


@pytest.mark.parametrize("t", [1, 2, 3, 10, 257, 1000])
@pytest.mark.parametrize("move", [False, True])
def test_filter_equals_step_by_step(t, move):
    _, y = K.simulate(P, t, np.random.default_rng(t))
    f = K.forward_filter(P, y, move)
    out, logs = plain_filter(P, y, move)
    np.testing.assert_allclose(f.filtered, out, atol=1e-12)
    np.testing.assert_allclose(f.log_c, logs, atol=1e-10)


def test_first_posterior():
    p = K.Params([0.3, 0.7], [[0.9, 0.1], [0.2, 0.8]], [0, 1], [1, 1])
    assert K.forward_filter(p, np.array([0.0])).filtered[0, 0] == pytest.approx(0.3 / (0.3 + 0.7 * math.exp(-0.5)))


def test_impossible_regime_meets_an_outlier():
    p = K.Params([1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], [0, 100], [1e-4, 1e-4])
    f = K.forward_filter(p, np.array([100.0, 100.0]))
    np.testing.assert_allclose(f.filtered, [[1, 0], [1, 0]])
    assert np.isfinite(f.log_c).all()


def test_smoother_and_pairs_agree_with_enumeration():
    from itertools import product

    _, y = K.simulate(P, 6, np.random.default_rng(1))
    d = np.exp(K.log_density(y, P.means, P.variances))
    weight, pairs = np.zeros((6, 2)), np.zeros((5, 2, 2))
    for path in product((0, 1), repeat=6):
        w = P.pi[path[0]] * d[0, path[0]]
        for t in range(1, 6):
            w *= P.transition[path[t - 1], path[t]] * d[t, path[t]]
        for t in range(6):
            weight[t, path[t]] += w
        for t in range(5):
            pairs[t, path[t], path[t + 1]] += w
    f = K.forward_filter(P, y)
    s = K.smooth(P, f)
    np.testing.assert_allclose(s, weight / weight.sum(1, keepdims=True), atol=1e-12)
    np.testing.assert_allclose(K.pairwise(P, f, s), pairs / pairs.sum((1, 2), keepdims=True), atol=1e-12)
    assert f.log_likelihood == pytest.approx(math.log(weight[0].sum()))


def test_m_step_fixture():
    g = np.array([[0.8, 0.2], [0.3, 0.7]])
    new = K.m_step(np.array([1.0, 2.0]), g, np.array([[0.24, 0.56], [0.06, 0.14]]), P)
    np.testing.assert_allclose(new.pi, [0.8, 0.2])
    np.testing.assert_allclose(new.transition, [[0.3, 0.7], [0.3, 0.7]])
    np.testing.assert_allclose(new.means, [1.4 / 1.1, 1.6 / 0.9])


def test_m_step_keeps_a_regime_without_weight():
    old = K.Params([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [0, 42], [1, 99])
    g = np.array([[1.0, 0.0]] * 3)
    new = K.m_step(np.array([1.0, 2.0, 3.0]), g, np.array([[2.0, 0.0], [0.0, 0.0]]), old)
    assert new.means[1] == 42 and new.variances[1] == 99
    np.testing.assert_allclose(new.transition, [[1.0, 0.0], [0.2, 0.8]])


def test_em_climbs_and_recovers():
    true = K.Params([0.5, 0.5], [[0.98, 0.02], [0.03, 0.97]], [-5, 5], [1, 2])
    _, y = K.simulate(true, 4000, np.random.default_rng(3))
    fit = K.fit_em(y, K.initial_params(y, 2), 1e-6, 200)
    assert (np.diff(fit.history) > -1e-8).all() and fit.converged
    o = np.argsort(fit.params.means)
    np.testing.assert_allclose(fit.params.means[o], [-5, 5], atol=0.2)
    np.testing.assert_allclose(np.diag(fit.params.transition)[o], [0.98, 0.97], atol=0.02)


def test_params_are_checked():
    for bad in (K.Params([1.0], [[1.0]], [0], [1]), K.Params([0.6, 0.6], [[1, 0], [0, 1]], [0, 0], [1, 1]), K.Params([0.5, 0.5], [[1, 0], [0, 1]], [0, 0], [1, 0])):
        with pytest.raises(K.ModelError):
            bad.check()


def test_stationary():
    np.testing.assert_allclose(K.stationary(np.array([[0.9, 0.1], [0.2, 0.8]])), [2 / 3, 1 / 3], atol=1e-8)


def filtered(rows, logs=None):
    rows = np.array(rows)
    return K.Filtered(np.empty(0), rows, np.zeros(len(rows)) if logs is None else np.array(logs))


def test_detectors():
    got = K.detect(K.Detector("hard_switch", 0.0), filtered([(0.9, 0.1), (0.1, 0.9)]))
    assert got["alarm"].tolist() == [False, True] and got["dominant"].tolist() == [0, 1]
    assert K.detect(K.Detector("hard_switch", 0.8), filtered([(0.9, 0.1), (0.4, 0.6)]))["score"].tolist() == [0, 0]
    assert K.detect(K.Detector("hard_switch", 0.0, 2), filtered([(0.9, 0.1), (0.1, 0.9), (0.9, 0.1)]))["alarm"].tolist() == [False, False, True]
    assert K.detect(K.Detector("leave_previous", 0.5), filtered([(0.9, 0.1), (0.7, 0.3)]))["score"][1] == pytest.approx(0.3)
    assert K.detect(K.Detector("total_variation", 0.5), filtered([(1, 0), (0, 1)]))["score"][1] == 1
    ema = K.detect(K.Detector("surprise", 2.0, alpha=0.5), filtered([(1, 0), (1, 0)], [-2.0, -5.0]))
    assert ema["score"].tolist() == [0, 3] and ema["alarm"].tolist() == [False, True]
    assert K.dominant(np.array([[0.5, 0.5]])).tolist() == [1]


def test_cooldown_swallows_crossings():
    assert K.persist([True] * 6, [True] * 6, 1, 2)[0] == [True, False, False, True, False, False]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 15))
def test_matching_equals_the_plain_greedy_rule(truth, alarms, window):
    used, expected = set(), []
    for tau in sorted(truth):
        for a in sorted(alarms):
            if a not in used and tau <= a < tau + window:
                used.add(a)
                expected.append((tau, a))
                break
    assert K.match_events(list(truth), list(alarms), window) == expected


@pytest.mark.parametrize("kind, alpha", [("hard_switch", None), ("leave_previous", None), ("total_variation", None), ("surprise", None), ("surprise", 0.3)])
def test_scores_resumed_at_any_cut_equal_those_of_one_pass(kind, alpha):
    rng = np.random.default_rng(3)
    filtered, log_c, d = rng.dirichlet((1, 1, 1), 40), rng.normal(-1, 1, 40), K.Detector(kind, 0.3, 1, 0, alpha)
    whole = K.scores(d, filtered, log_c)
    for cuts in ([1], [7, 8, 30], list(range(1, 40))):
        parts, before, base = [], None, None
        for a, b in zip([0, *cuts], [*cuts, 40]):
            *got, base = K.resume(d, filtered[a:b], log_c[a:b], before, base)
            parts.append(got)
            before = filtered[b - 1]
        for want, got in zip(whole, zip(*parts)):
            assert np.array_equal(want, np.concatenate(got))


@pytest.mark.parametrize("k, n", [(2, 1), (2, 2), (2, 3), (2, 50), (3, 997), (2, 1024), (3, 4096), (2, 5000)])
def test_a_step_in_blocks_equals_the_plain_one(k, n):
    rng = np.random.default_rng(n)
    y = rng.standard_normal(n) * (1 + 3 * (np.arange(n) % 40 < 10))
    p = K.initial_params(y, k)
    p = K.Params(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), p.means, p.variances + 0.1)
    f = K.forward_filter(p, y)
    s = K.smooth(p, f)
    want = K.m_step(y, s, K.pairwise(p, f, s).sum(0), p)
    blocks = K.Blocks(y, k)
    assert blocks.forward(p) == pytest.approx(f.log_likelihood, rel=1e-12)
    got = blocks.update(p)
    for a, b in zip((got.pi, got.transition, got.means, got.variances), (want.pi, want.transition, want.means, want.variances)):
        np.testing.assert_allclose(a, b, atol=1e-10)


def test_blocks_leave_vanishing_sums_to_the_log_domain():
    y = np.array([0.0, 0.1, 60.0, 0.0, 0.2, -0.1])
    p = K.Params([1.0, 0.0], [[1.0, 0.0], [0.5, 0.5]], [0.0, 60.0], [1.0, 1.0])
    assert K.Blocks(y, 2).forward(p) is None
    fit = K.fit_em(y, p, max_iter=3)
    assert fit.history[0] == K.forward_filter(p, y).log_likelihood and np.isfinite(fit.history).all()


def test_a_step_of_a_long_series_is_quick():
    """At 60 times sf0.1 a series has 1.2 million rows, and a fit some hundred steps."""
    y = np.random.default_rng(1).standard_normal(300_000)
    p = K.initial_params(y, 2)
    f, t = K.forward_filter(p, y), time.process_time()
    s = K.smooth(p, f)
    K.m_step(y, s, K.pairwise(p, f, s).sum(0), p)
    K.forward_filter(p, y)
    plain, t = time.process_time() - t, time.process_time()
    K.fit_em(y, p, 0.0, 4)
    assert (time.process_time() - t) / 4.5 < plain / 2
