"""The registered experiments."""

from __future__ import annotations

from ..functions.kernels import Detector
from ..operators.calibrate import Mapping
from ..operators.features import Feature
from .config import Data, Evaluation, Experiment, Model

_REAL_MODEL = Model(max_iter=300, tol=1e-7)


def _synthetic(label: str, detector: Detector, **more) -> Experiment:
    return Experiment(label, "synthetic", detector=detector, **more)


def _real(label: str, asset: str, detector: Detector, data: dict, evaluation: Evaluation, **more) -> Experiment:
    return Experiment(label, "real", data=Data(asset=asset, **data), model=_REAL_MODEL, detector=detector, evaluation=evaluation, **more)


def _transfer(label: str, asset: str, k: int, family: str) -> Experiment:
    mapping = Mapping(k=k, horizon=2000, strategy="quick_em")
    return Experiment(label, "sim_to_real", data=Data(asset=asset, start="2018-01-01", mapping=mapping), feature=Feature(family), model=Model(k=k), detector=Detector("hard_switch", 0.55, 2, 5), evaluation=Evaluation(pre=5, post=10, min_segment=10))


def registry() -> dict[str, Experiment]:
    """All by label."""
    # Labels and settings of the experiments.
    daily, days = {"start": "2018-01-01"}, Evaluation(pre=5, post=10, min_segment=10)
    all_ = [
        _synthetic("hard_switch", Detector("hard_switch", 0.5, 2, 5)),
        _synthetic("posterior_transition", Detector("leave_previous", 0.3, 2, 5)),
        _synthetic("surprise", Detector("surprise", 2.5, 2, 5)),
        _synthetic("posterior_transition_tv", Detector("total_variation", 0.3, 2, 5)),
        _synthetic("hard_switch_shock", Detector("hard_switch", 0.5, 2, 5), data=Data("shock_contaminated")),
        _synthetic("hard_switch_frozen", Detector("hard_switch", 0.5, 2, 5), model=Model(frozen="data/frozen_models/hard_switch_frozen/model_params.json")),
        _synthetic("hard_switch_multi_start", Detector("hard_switch", 0.5, 2, 5), model=Model(n_starts=3)),
        _synthetic("surprise_ema", Detector("surprise", 2.5, 2, 5, 0.3)),
        _synthetic("squared_return_surprise", Detector("surprise", 2.5, 2, 5), feature=Feature("squared_return")),
        _real("real_spy_daily_hard_switch", "spy", Detector("hard_switch", 0.55, 2, 5), daily, days),
        _real("real_wti_daily_surprise", "wti", Detector("surprise", 3.0, 2, 10), daily, days),
        _real("real_spy_intraday_hard_switch", "spy", Detector("hard_switch", 0.55, 3, 10), {"frequency": "15min", "start": "2022-01-01", "end": "2025-12-31", "regular_hours": True}, Evaluation(pre=20, post=40, min_segment=20), feature=Feature(session_aware=True)),
        _transfer("simreal_spy_daily_hard_switch", "spy", 2, "log_return"),
        *(_transfer(f"simreal_{a}_daily_abs_return_k3", a, 3, "abs_return") for a in ("spy", "wti", "gold")),
    ]
    return {e.label: e for e in all_}


def template(mode: str = "synthetic") -> Experiment:
    """A configuration to start from."""
    return {"synthetic": registry()["hard_switch"], "real": registry()["real_spy_daily_hard_switch"], "sim_to_real": registry()["simreal_spy_daily_hard_switch"]}[mode]
