"""Runs experiments: data, features, model, online run, evaluation, export.

Each stage passes a DataFrame on; the features and the filtered rows are cached, as later stages read them again. Only
parameters, metrics, the delays and, a partition at a time, the traces that are to be written reach the driver. A stage that fails
ends the run with its name and message; a failing export makes it a partial success.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import calibrate, clean, detect, evaluate, features, hmm, search
from ..operators.clean import SERIES
from ..sources import files
from . import plots
from .config import FREQUENCIES, Experiment

#: Fixed value: the fewest rows that a real series must have.
LEAST_ROWS = 10


@dataclass
class Result:
    run_id: str
    label: str
    mode: str
    status: str = "success"
    stage: str | None = None
    message: str | None = None
    folder: str | None = None
    timings: dict[str, float] = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    fit: dict = field(default_factory=dict)
    evaluation: dict = field(default_factory=dict)
    n_alarms: int = 0
    notes: list[str] = field(default_factory=list)

    @property
    def score(self) -> float:
        """Half coverage and half precision; the mean of three figures on real series."""
        e = self.evaluation
        if "event_coverage" in e:
            return (e["event_coverage"] + e["alarm_relevance"] + e["coherence"]) / 3
        return 0.5 * e.get("coverage", 0.0) + 0.5 * e.get("precision", 0.0)


class Failed(Exception):
    def __init__(self, stage: str, error: Exception):
        super().__init__(str(error))
        self.stage, self.error = stage, error


class Runner:
    """prices: (series_id, ts, value) of real assets, whose ids are the assets' names; events: as files.read_events gives them, or None for the configured path."""

    def __init__(self, spark: SparkSession, prices: DataFrame | None = None, events: DataFrame | None = None):
        self.spark, self.prices, self.events = spark, prices, events

    # --- stages

    def _real(self, e: Experiment) -> DataFrame:
        if self.prices is None:
            raise ValueError("no prices to read the asset from")
        df = clean.date_range(self.prices.where(F.col(SERIES) == e.data.asset), e.data.start, e.data.end)
        if e.data.regular_hours:
            df = clean.regular_hours(df)
        n = df.count()
        if n < LEAST_ROWS:
            raise ValueError(f"{n} rows of {e.data.asset}, at least {LEAST_ROWS} are needed")
        return df

    def _synthetic(self, e: Experiment, p: K.Params | None = None) -> DataFrame:
        p = p or hmm.scenario(e.data.scenario, e.model.k)
        return hmm.simulate(self.spark, [(e.data.scenario if e.mode != "sim_to_real" else "simulated", p, e.data.horizon, e.seed or 0, e.data.jump_prob, e.data.jump_scale)])

    def _scaled_simulation(self, e: Experiment, states: DataFrame) -> DataFrame:
        """Simulated values as they are: the simulator makes returns; scaled by mean and deviation of the train share unless scaling is none."""
        obs = clean.daily_timestamps(states.select(SERIES, "t", "y"))
        if e.feature.scaling == "none":
            return obs.select(SERIES, "t", "ts", "y")
        n = states.groupBy(SERIES).agg(F.floor(0.7 * F.count("*")).alias("n"))
        scaler = features.fit_scaler(obs.join(n, SERIES).where("t <= n"), "zscore", 1e-10)
        return features.apply_scaler(obs, scaler).select(SERIES, "t", "ts", "y")

    def _fit(self, e: Experiment, train: DataFrame) -> tuple[K.Params, dict]:
        if e.model.frozen:
            return files.read_params(e.model.frozen), {"source": e.model.frozen}
        fits = hmm.fit_em(train, e.model.k, e.model.tol, e.model.max_iter, e.model.n_starts, e.model.jitter, e.seed or 0)
        rows = sorted(fits.collect(), key=lambda r: r["start"])  # a row a start
        best = max(rows, key=lambda r: (r["log_likelihood"], r["start"]))
        lls = sorted((r["log_likelihood"] for r in rows), reverse=True)
        return hmm.params_of(best), {"log_likelihood": best["log_likelihood"], "n_iter": best["n_iter"], "converged": best["converged"], "history": list(best["history"]), "starts": [{"start": r["start"], "log_likelihood": r["log_likelihood"], "n_iter": r["n_iter"], "converged": r["converged"]} for r in rows], "spread": lls[0] - lls[-1]}

    def run(self, e: Experiment, write: bool = True) -> Result:
        out = Result(e.run_id(), e.label, e.mode)

        def stage(name: str, body: Callable):
            began = time.monotonic()
            try:
                return body()
            except Exception as error:
                raise Failed(name, error) from error
            finally:
                out.timings[name] = time.monotonic() - began

        cached: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            cached.append(df.cache())
            df.count()
            return df

        try:
            if write:
                out.folder = os.path.join(e.output.root, e.mode, files.safe_name(e.label), out.run_id)
                stage("prepare", lambda: files.write_json(f"{out.folder}/config.snapshot.json", asdict(e)))
            stage("validate", e.check)
            if e.mode == "dry_run":
                out.evaluation = {"coverage": 0.5, "precision": 0.5, "dry_run": True}
                out.notes.append("dry run: the metrics are made up")
                return self._write(e, out, None) if write else out
            truth = bars = report = None
            if e.mode == "synthetic":
                states = stage("resolve_data", lambda: keep(self._synthetic(e)))
                truth = hmm.change_points(states)
                obs = stage("build_features", lambda: keep(self._scaled_simulation(e, states)))
                train = obs
            else:
                bars = stage("resolve_data", lambda: keep(self._real(e)))
                report = clean.quality_report(bars.withColumn("ord", F.row_number().over(clean.by_time())), FREQUENCIES[e.data.frequency])
                f = replace(e.feature, session_aware=e.feature.session_aware and e.data.frequency != "daily")
                obs = stage("build_features", lambda: keep(features.stream(bars, f, strict=e.strict_split)))
                n_train = features.train_rows(bars).first()["n_train"] - f.warmup
                train = obs.where(F.col("t") <= max(int(n_train), 2))
                if e.mode == "sim_to_real":
                    train = stage("simulate", lambda: keep(self._transfer(e, bars, f, out)))
            params, out.fit = stage("train_or_load_model", lambda: self._fit(e, train))
            out.params = params.row()
            rows = stage("run_online", lambda: keep(hmm.filter_rows(obs, params, True)))
            steps = keep(detect.alarms(rows, e.detector))
            alarms = steps.where("alarm").select(SERIES, "t")
            out.n_alarms = alarms.count()
            extra = stage("evaluate", lambda: self._evaluate(e, out, obs, alarms, truth, bars))
            if write:
                try:
                    stage("export", lambda: self._write(e, out, {"obs": obs, "train": train, "rows": rows, "steps": steps, "truth": truth, "report": report, "params": params, **extra}))
                except Failed as failed:
                    out.status, out.stage, out.message = "partial_success", failed.stage, str(failed.error).splitlines()[0]
        except Failed as failed:
            out.status, out.stage, out.message = "failed", failed.stage, str(failed.error).splitlines()[0] if str(failed.error) else type(failed.error).__name__
        finally:
            for df in cached:
                df.unpersist()
        return out

    def _transfer(self, e: Experiment, bars: DataFrame, f: features.Feature, out: Result) -> DataFrame:
        """Calibrate on the train share's log returns, simulate, and scale by the real series' scaler."""
        n = features.train_rows(bars).first()["n_train"]
        raw = features.numbered(features.returns(bars))
        source = raw.where(F.col("t") < max(int(n), 3))
        mapping = replace(e.data.mapping, k=e.model.k)
        params = hmm.params_of(calibrate.calibrated_params(source, mapping).first())
        states = self._synthetic(replace(e, data=replace(e.data, horizon=mapping.horizon)), params)
        real, syn = (calibrate.moments(x.withColumn(SERIES, F.lit("x"))) for x in (source, states))
        check = calibrate.scale_check(calibrate.joined(real, syn, ("std_dev",))).first()
        out.notes.append(f"scale check: real {check['real_std']:.6f}, synthetic {check['synthetic_std']:.6f}, error {check['relative_error']:.4f}, {'ok' if check['ok'] else 'beyond the limit'}")
        out.fit["calibrated"] = params.row()
        all_ = features.numbered(features.raw(bars, f))
        scaler = features.fit_scaler(all_.where(F.col("t") <= int(n)), f.scaling).withColumn(SERIES, F.lit("simulated"))
        return features.apply_scaler(clean.daily_timestamps(states.select(SERIES, "t", "y")), scaler).select(SERIES, "t", "ts", "y")

    def _evaluate(self, e: Experiment, out: Result, obs: DataFrame, alarms: DataFrame, truth: DataFrame | None, bars: DataFrame | None) -> dict:
        lengths = obs.groupBy(SERIES).agg(F.count("*").alias("n"))
        if e.mode == "synthetic":
            matches = evaluate.match_events(truth, alarms, e.evaluation.window)
            m = evaluate.metric_suite(matches, alarms, lengths).first()
            value = lambda c: 0.0 if m[c] is None or np.isnan(m[c]) else float(m[c])  # noqa: E731  undefined counts as 0 here
            out.evaluation = {"coverage": value("recall"), "precision": value("precision"), "n_events": m["n_events"], "miss_rate": value("miss_rate"), "false_alarm_rate": value("false_alarm_rate"), "delay_mean": value("delay_mean"), "delay_median": value("delay_median")}
            return {"delays": sorted(r["delay"] for r in matches.where("delay IS NOT NULL").collect())}
        events = self.events if self.events is not None else files.read_events(self.spark, e.evaluation.events, e.data.asset)
        events = events.withColumn(SERIES, F.lit(e.data.asset))
        a = evaluate.route_a(obs, alarms, events, e.evaluation.pre, e.evaluation.post, e.evaluation.causal)
        b = evaluate.route_b(obs, alarms, e.evaluation.min_segment)
        ra, rb = a.first().asDict(), b.first().asDict()
        out.evaluation = {"event_coverage": ra["event_coverage"], "alarm_relevance": ra["alarm_relevance"], "coherence": rb["coherence"]}
        return {"route_a": ra, "route_b": rb, "delays": []}

    # --- export

    def _write(self, e: Experiment, out: Result, parts: dict | None) -> Result:
        at = lambda name: f"{out.folder}/{name}"
        if parts and e.output.json:
            files.write_params(at("model_params.json"), parts["params"])
            files.write_json(at("fit_summary.json"), {k: v for k, v in out.fit.items() if k not in ("history", "starts")})
            files.write_json(at("detector_config.json"), asdict(e.detector))
            files.write_json(at("feature_summary.json"), features.summary(parts["obs"]).first().asDict() | {"warmup": e.feature.warmup, "label": e.feature.label(e.data.asset or e.data.scenario)})
            smoothed = hmm.smooth_rows(parts["train"], parts["params"])
            regimes = [r.asDict() for r in hmm.regime_summary(smoothed, parts["params"]).collect()]
            validity = hmm.posterior_validity(smoothed, hmm.pairwise(smoothed, parts["params"].transition)).first().asDict()
            files.write_json(at("diagnostics.json"), {"regimes": regimes, "posterior": validity, "trustworthy": max(v for v in validity.values() if isinstance(v, float)) <= 1e-8})
            if len(out.fit.get("starts", [])) > 1:
                files.write_json(at("multi_start_summary.json"), {"starts": out.fit["starts"], "spread": out.fit["spread"], "unstable": out.fit["spread"] > hmm.UNSTABLE_SPREAD})
            if parts["report"] is not None:
                files.write_json(at("data_quality.json"), parts["report"].first().asDict())
                files.write_json(at("split_summary.json" if e.mode == "real" else "synthetic_training_provenance.json"), {"notes": out.notes, "n_train": parts["train"].count(), "n": parts["obs"].count()})
            for name in ("route_a", "route_b"):
                if name in parts:
                    files.write_json(at(f"{name}_result.json"), parts[name])
            if e.mode == "sim_to_real":
                files.write_json(at("sim_to_real_summary.json"), {"calibrated": out.fit.get("calibrated"), "evaluation": out.evaluation, "notes": out.notes})
        if parts and e.output.traces:
            self._write_traces(e, out, parts, at)
        table = files.MetricsTable([summary_row(out)])
        for name, text in (("metrics.md", table.to_markdown()), ("metrics.csv", table.to_csv()), ("metrics.tex", table.to_latex())):
            os.makedirs(out.folder, exist_ok=True)
            with open(at(name), "w", encoding="utf-8") as f:
                f.write(text)
        if e.output.json:
            files.write_json(at("summary.json"), summary_row(out))
            files.write_json(at("result.json"), asdict(out))
        return out

    def _write_traces(self, e: Experiment, out: Result, parts: dict, at: Callable[[str], str]) -> None:
        """Tables go through the driver a partition at a time, plots take a thinned series."""
        steps, rows, truth, k = parts["steps"], parts["rows"], parts["truth"], parts["params"].k
        alarms = steps.where("alarm").select(SERIES, "t")

        def in_time(df: DataFrame):
            return df.orderBy("t").toLocalIterator()

        if e.output.csv:
            files.write_csv(at("score_trace.csv"), ["t", "score"], map(tuple, in_time(steps.select("t", "score"))))
            files.write_csv(at("alarms.csv"), ["alarm_n", "t"], ((i, r["t"]) for i, r in enumerate(in_time(alarms), 1)))
            files.write_csv(at("regime_posteriors.csv"), ["t", *[f"p{j}" for j in range(k)]], ((r["t"], *r["filtered"]) for r in in_time(rows.select("t", "filtered"))))
            files.write_csv(at("loglikelihood_history.csv"), ["iteration", "log_likelihood"], enumerate(out.fit.get("history", [])))
            if truth is not None:
                files.write_csv(at("changepoints.csv"), ["cp_n", "t"], ((i, r["t"]) for i, r in enumerate(in_time(truth), 1)))
            else:
                files.write_csv(at("real_eval_summary.csv"), ["metric", "value"], out.evaluation.items(), 6)
        if e.output.plots:
            n = rows.agg(F.max("t")).first()[0]
            signal, found = plots.thinned(rows, F.col("y"), n), plots.marks(alarms, n)
            plots.signal_with_alarms(at("signal_alarms.png"), n, signal, found, plots.marks(truth, n) if truth is not None else ())
            plots.detector_scores(at("detector_scores.png"), n, plots.thinned(steps, F.col("score"), n), e.detector.threshold, found)
            plots.regime_posteriors(at("regime_posteriors.png"), n, [plots.thinned(rows, F.col("filtered")[j], n) for j in range(k)])
            plots.delay_distribution(at("delay_distribution.png"), parts["delays"])
            plots.segmentation(at("segmentation.png"), n, signal, plots.segment_means(evaluate.segments(rows.select(SERIES, "t", "y"), alarms), n))

    def calibrate(self, e: Experiment) -> tuple[Experiment, dict, dict, list[dict]]:
        """The experiment, the summary of its train share, the parameters calibrated to that, and the verification of what they simulate."""
        if e.mode != "synthetic":
            raise ValueError("this experiment isn't synthetic; calibrate to its asset")
        obs = self._scaled_simulation(e.check(), self._synthetic(e))
        train = obs.where(F.col("t") <= int(0.7 * e.data.horizon)).cache()
        try:
            params, _, checks = calibrate.workflow(train, calibrate.Mapping(k=e.model.k, horizon=e.data.horizon), e.seed or 42)
            return e, calibrate.empirical_summary(train).first().asDict(), params.first().asDict(True), [r.asDict() for r in checks.collect()]
        finally:
            train.unpersist()

    # --- several runs

    def batch(self, experiments: list[Experiment], stop_on_error: bool = False, write: bool = True) -> list[Result]:
        out = []
        for e in experiments:
            out.append(self.run(e, write))
            if stop_on_error and out[-1].status == "failed":
                break
        return out

    def optimize(self, e: Experiment, grid: search.Grid, models: list[tuple[int, features.Feature]] | None = None) -> list[tuple[float, Experiment]]:
        """Every point's score and configuration, best first and equal ones in the order of the grid; one fit for each model. Undefined scores come last."""
        found = []
        for k, f in models or [(e.model.k, e.feature)]:
            base = replace(e, model=replace(e.model, k=k), feature=f)
            if e.mode == "synthetic":
                states = self._synthetic(base)
                obs, truth = self._scaled_simulation(base, states).cache(), hmm.change_points(states)
                params, _ = self._fit(base, obs)
                rows = hmm.filter_rows(obs, params, True)
                scored = {r["point"]: r["score"] for r in search.score_synthetic(search.alarm_grid(rows, e.detector.kind, grid, e.detector.alpha), truth, e.evaluation.window).collect()}
                obs.unpersist()
            else:
                scored = {i: self.run(replace(base, detector=K.Detector(e.detector.kind, *p, e.detector.alpha)), write=False).score for i, p in enumerate(grid.points())}
            found += [(scored.get(i, float("nan")), replace(base, detector=K.Detector(e.detector.kind, *p, e.detector.alpha))) for i, p in enumerate(grid.points())]
        return sorted(found, key=lambda x: (np.isnan(x[0]), -x[0] if not np.isnan(x[0]) else 0.0))


def summary_row(r: Result) -> dict:
    return {"run_id": r.run_id, "label": r.label, "mode": r.mode, "status": r.status, "n_alarms": r.n_alarms, **{k: v for k, v in r.evaluation.items() if isinstance(v, int | float) and not isinstance(v, bool)}}


def read_runs(root: str) -> list[dict]:
    """Summaries below a folder, in the order of their paths; unreadable ones are left out."""
    import json

    out = []
    for folder, _, names in sorted(os.walk(root)):
        if "summary.json" in names:
            try:
                with open(os.path.join(folder, "summary.json"), encoding="utf-8") as f:
                    out.append(json.load(f) | {"folder": folder})
            except (OSError, ValueError):
                continue
    return out


def compare_runs(root: str) -> files.MetricsTable:
    rows = read_runs(root)
    return files.MetricsTable([{k: v for k, v in r.items() if k != "folder"} for r in rows])
