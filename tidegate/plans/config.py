"""What an experiment is, as dataclasses that read from and write to JSON, each with its own checks."""

from __future__ import annotations

import hashlib
import json
import math
import time
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

from ..functions.kernels import Detector
from ..operators.calibrate import Mapping
from ..operators.features import Feature

MODES = ("synthetic", "real", "sim_to_real", "dry_run")
FREQUENCIES = {"daily": None, "5min": 5, "15min": 15}


class ConfigError(ValueError):
    """A configuration that can't be run."""


def need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class Data:
    """scenario and horizon of synthetic series; asset, frequency and days of real ones; mapping and jumps of calibrated ones."""

    scenario: str = "scenario_calibrated"
    horizon: int = 2000
    asset: str = ""
    frequency: str = "daily"
    start: str | None = None
    end: str | None = None
    regular_hours: bool = False
    mapping: Mapping = field(default_factory=Mapping)
    jump_prob: float = 0.0
    jump_scale: float = 0.0

    def check(self, mode: str) -> None:
        if mode in ("real", "sim_to_real"):
            need(bool(self.asset.strip()), "a real asset needs a name")
            need(self.frequency in FREQUENCIES, f"no frequency {self.frequency!r}")
        else:
            need(bool(self.scenario.strip()), "a scenario needs a name")
        if mode != "real":
            need(self.horizon >= 2, "a synthetic series has at least two steps")
        if mode == "sim_to_real":
            self.mapping.check()


@dataclass(frozen=True)
class Model:
    k: int = 2
    max_iter: int = 200
    tol: float = 1e-6
    n_starts: int = 1
    jitter: float = 0.0
    frozen: str | None = None

    def check(self) -> None:
        need(self.k >= 2, "a model has at least two regimes")
        need(self.max_iter > 0 and self.n_starts > 0, "at least one iteration and one start are needed")
        need(math.isfinite(self.tol) and self.tol > 0, "the tolerance must be finite and above zero")
        need(self.frozen is None or bool(self.frozen.strip()), "a frozen model needs a path")


@dataclass(frozen=True)
class Evaluation:
    window: int = 20
    events: str = ""
    pre: int = 3
    post: int = 3
    causal: bool = False
    min_segment: int = 5

    def check(self) -> None:
        need(self.window > 0 and self.pre >= 0 and self.post >= 0 and self.min_segment > 0, "windows and lengths must be above zero")


@dataclass(frozen=True)
class Output:
    root: str = "runs"
    json: bool = True
    csv: bool = True
    traces: bool = True
    plots: bool = True

    def check(self) -> None:
        need(bool(self.root.strip()), "an output folder is needed")


@dataclass(frozen=True)
class Experiment:
    label: str
    mode: str = "synthetic"
    notes: str | None = None
    data: Data = field(default_factory=Data)
    feature: Feature = field(default_factory=Feature)
    model: Model = field(default_factory=Model)
    detector: Detector = field(default_factory=lambda: Detector("hard_switch", 0.5, 2, 5))
    evaluation: Evaluation = field(default_factory=Evaluation)
    output: Output = field(default_factory=Output)
    seed: int | None = 42
    deterministic_id: bool = True
    strict_split: bool = False

    def check(self) -> Experiment:
        need(bool(self.label.strip()), "a run needs a label")
        need(self.mode in MODES, f"no mode {self.mode!r}")
        self.data.check(self.mode)
        self.feature.check()
        self.model.check()
        self.detector.check()
        self.evaluation.check()
        self.output.check()
        need(not self.deterministic_id or self.seed is not None, "a run id that is to repeat needs a seed")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @property
    def digest(self) -> str:
        """16 hexadecimal digits of the configuration."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    def run_id(self) -> str:
        return f"run_{self.digest}_{self.seed if self.deterministic_id else format(int(time.time() * 1000), 'x')}"

    def with_(self, **changes) -> Experiment:
        return replace(self, **changes)


def _build(kind, value):
    if not is_dataclass(kind):
        return value
    known = {f.name: f for f in fields(kind)}
    unknown = set(value) - set(known)
    need(not unknown, f"unknown settings {sorted(unknown)} of {kind.__name__}")
    parts = {"data": Data, "feature": Feature, "model": Model, "detector": Detector, "evaluation": Evaluation, "output": Output, "mapping": Mapping}
    made = {k: _build(parts[k], v) if k in parts else tuple(v) if isinstance(v, list) else v for k, v in value.items()}
    return kind(**made)


def from_json(text: str) -> Experiment:
    try:
        value = json.loads(text)
    except json.JSONDecodeError as e:
        raise ConfigError(f"not JSON: {e}") from None
    need(isinstance(value, dict) and "label" in value, "an experiment is an object with a label")
    return _build(Experiment, value)


def load(path: str) -> Experiment:
    with open(path, encoding="utf-8") as f:
        return from_json(f.read())
