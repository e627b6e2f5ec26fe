"""The filter on simulated scenarios, from well separated to barely informative ones, short and long."""

import numpy as np
import pytest

from tidegate.functions import kernels as K


def scenario(stay, means, variances):
    return K.Params([0.5, 0.5], [[stay, 1 - stay], [1 - stay, stay]], means, variances)


SCENARIOS = {
    "separated": (scenario(0.99, [-10, 10], [1, 1]), 1_000, 0.99),
    "weak": (scenario(0.9, [-0.5, 0.5], [1, 1]), 1_000, 0.65),
    "mean only": (scenario(0.95, [-5, 5], [2, 2]), 1_000, 0.99),
    "variance only": (scenario(0.95, [0, 0], [0.25, 9]), 1_000, 0.85),
    "persistent": (scenario(0.999, [-3, 3], [1, 1]), 2_000, 0.99),
    "frequent": (scenario(0.4, [-5, 5], [1, 1]), 1_000, 0.99),
    "short": (scenario(0.9, [-5, 5], [1, 1]), 10, 0.9),
    "long": (scenario(0.99, [-5, 5], [1, 1]), 50_000, 0.99),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_filter_on_scenarios(name):
    p, t, least = SCENARIOS[name]
    states, y = K.simulate(p, t, np.random.Generator(np.random.PCG64(42)))
    f = K.forward_filter(p, y)
    assert f.filtered.shape == (t, 2) and np.isfinite(f.log_c).all()
    np.testing.assert_allclose(f.filtered.sum(1), 1, atol=1e-9)
    np.testing.assert_allclose(f.predicted[1:], f.filtered[:-1] @ p.transition, atol=1e-12)
    assert (K.dominant(f.filtered) == states).mean() >= least
    s = K.smooth(p, f)
    np.testing.assert_allclose(s.sum(1), 1, atol=1e-9)
    np.testing.assert_allclose(K.pairwise(p, f, s).sum(2), s[:-1], atol=1e-6)
    assert (K.dominant(s) == states).mean() >= least - 0.02


def test_true_parameters_are_likelier_than_others():
    p = SCENARIOS["mean only"][0]
    _, y = K.simulate(p, 2_000, np.random.Generator(np.random.PCG64(1)))
    best = K.forward_filter(p, y).log_likelihood
    for other in (scenario(0.5, [-5, 5], [2, 2]), scenario(0.95, [-4, 4], [2, 2]), scenario(0.95, [-5, 5], [4, 4])):
        assert K.forward_filter(other, y).log_likelihood < best


@pytest.mark.parametrize("seed", range(5))
def test_online_equals_offline_for_a_stationary_start(seed):
    p = K.Params([0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], [-3, 3], [1, 1])
    _, y = K.simulate(p, 300, np.random.Generator(np.random.PCG64(seed)))
    np.testing.assert_allclose(K.forward_filter(p, y, True).filtered, K.forward_filter(p, y, False).filtered, atol=1e-12)


def test_three_regimes():
    p = K.Params([1 / 3] * 3, np.full((3, 3), 0.02) + 0.94 * np.eye(3), [-5, 0, 5], [1, 1, 1])
    states, y = K.simulate(p, 3_000, np.random.Generator(np.random.PCG64(7)))
    fit = K.fit_em(y, K.initial_params(y, 3), 1e-6, 200)
    o = np.argsort(fit.params.means)
    np.testing.assert_allclose(fit.params.means[o], [-5, 0, 5], atol=0.3)
    assert (K.dominant(K.forward_filter(p, y).filtered) == states).mean() > 0.95


def test_jumps_widen_the_tails():
    p = SCENARIOS["mean only"][0]
    plain, jumpy = (K.simulate(p, 20_000, np.random.Generator(np.random.PCG64(3)), jump, 6.0)[1] for jump in (0.0, 0.05))
    assert np.abs(jumpy).max() > 1.5 * np.abs(plain).max()


def test_bad_observations_are_told():
    p = SCENARIOS["weak"][0]
    for bad in ([], [1.0, float("nan")], [float("inf")]):
        with pytest.raises(K.ModelError):
            K.forward_filter(p, np.array(bad))
