import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.functions import kernels as K
from tidegate.operators import search
from tidegate.plans import cli, config, menu, plots, registry
from tidegate.plans.config import Data, Evaluation, Experiment, Model, Output
from tidegate.plans.runner import Runner, compare_runs, read_runs

FILES = {"config.snapshot.json", "result.json", "summary.json", "model_params.json", "fit_summary.json", "metrics.md", "metrics.csv", "metrics.tex", "diagnostics.json", "loglikelihood_history.csv", "feature_summary.json", "score_trace.csv", "alarms.csv", "regime_posteriors.csv", "detector_config.json", "signal_alarms.png", "detector_scores.png", "regime_posteriors.png", "delay_distribution.png", "segmentation.png"}


@pytest.fixture(scope="module")
def prices(spark):
    rows = [(a, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), 400 * (1 + 0.001 * (i * s % 17 - 8)) + (40 * np.sin(i / 3) if i // 60 % 2 else 0)) for a, s in (("spy", 1), ("wti", 3)) for i in range(500)]
    return spark.createDataFrame([(a, t, float(v)) for a, t, v in rows], "series_id string, ts timestamp_ntz, value double")


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([("spy", "a", "point", dt.datetime(2020, 3, 1), None), ("spy", "b", "window", dt.datetime(2020, 5, 1), dt.datetime(2020, 6, 1))], "series_id string, id string, kind string, start timestamp_ntz, end timestamp_ntz")


def test_registry_round_trips_and_is_valid():
    all_ = registry.registry()
    assert len(all_) == 16
    for e in all_.values():
        assert config.from_json(e.check().to_json()) == e
    assert all_["hard_switch"].run_id() == all_["hard_switch"].run_id() and all_["hard_switch"].digest != all_["surprise"].digest


@pytest.mark.parametrize("bad", [Experiment(""), Experiment("x", "odd"), Experiment("x", model=Model(k=1)), Experiment("x", model=Model(tol=0)), Experiment("x", seed=None), Experiment("x", "real"), Experiment("x", data=Data(horizon=1)), Experiment("x", detector=K.Detector("hard_switch", float("nan"))), Experiment("x", output=Output(root=" ")), Experiment("x", evaluation=Evaluation(window=0))])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        bad.check()


def test_unknown_settings_are_told():
    with pytest.raises(config.ConfigError):
        config.from_json('{"label": "x", "odd": 1}')


def test_synthetic_run(spark, tmp_path):
    e = Experiment("a b", data=Data("persistent_states", 600), model=Model(max_iter=50, n_starts=2), output=Output(str(tmp_path)))
    r = Runner(spark).run(e)
    assert r.status == "success" and FILES | {"changepoints.csv", "multi_start_summary.json"} <= set(os.listdir(r.folder))
    assert 0 <= r.evaluation["coverage"] <= 1 and r.folder.startswith(str(tmp_path / "synthetic" / "a_b"))
    assert Runner(spark).run(e, write=False).evaluation == r.evaluation
    ranked = Runner(spark).optimize(e, search.Grid((0.3, 0.5), (1, 2), (5,)))
    assert len(ranked) == 4 and [s for s, _ in ranked] == sorted((s for s, _ in ranked), reverse=True)
    best, again = ranked[0][1], dict((x.detector.threshold, s) for s, x in ranked if x.detector.required == 2)
    assert Runner(spark).run(best, write=False).score == pytest.approx(ranked[0][0]) and again[0.5] == pytest.approx(r.score)
    frozen = Experiment("f", data=Data("persistent_states", 600), model=Model(frozen=f"{r.folder}/model_params.json"), output=Output(str(tmp_path)))
    assert Runner(spark).run(frozen).evaluation == r.evaluation
    assert [x["label"] for x in read_runs(str(tmp_path))] == ["a b", "f"] and "| a b |" in compare_runs(str(tmp_path)).to_markdown()


@pytest.mark.parametrize("mode", ["real", "sim_to_real"])
def test_real_runs(spark, prices, events, tmp_path, mode):
    e = Experiment("r", mode, data=Data(asset="spy", start="2020-01-05"), model=Model(max_iter=30), output=Output(str(tmp_path)))
    r = Runner(spark, prices, events).run(e)
    assert (r.status, r.message) == ("success", None) and {"route_a_result.json", "route_b_result.json", "data_quality.json"} <= set(os.listdir(r.folder))
    assert json.load(open(f"{r.folder}/route_a_result.json"))["n_events"] == 2
    if mode == "sim_to_real":
        assert r.notes[0].startswith("scale check")


def test_failures_name_their_stage(spark, prices, tmp_path):
    runner = Runner(spark, prices)
    bad = [Experiment("x", "real", data=Data(asset="none"), output=Output(str(tmp_path))), Experiment("x", model=Model(k=1), output=Output(str(tmp_path))), Experiment("x", model=Model(frozen="/none.json"), output=Output(str(tmp_path)))]
    assert [r.stage for r in runner.batch(bad)] == ["resolve_data", "validate", "train_or_load_model"]
    assert len(runner.batch(bad, stop_on_error=True)) == 1
    dry = runner.run(Experiment("x", "dry_run", output=Output(str(tmp_path))))
    assert dry.status == "success" and dry.evaluation["dry_run"]


def test_plots_are_png(tmp_path):
    path = str(tmp_path / "p.png")
    for draw in (lambda: plots.signal_with_alarms(path, 3, [(1, 1.0), (2, float("nan")), (3, 2.0)], [2], [1]), lambda: plots.detector_scores(path, 0, [], 0.5, []), lambda: plots.regime_posteriors(path, 2, [[(1, 0.1), (2, 0.5)], [(1, 0.9), (2, 0.5)]]), lambda: plots.delay_distribution(path, []), lambda: plots.segmentation(path, 3, [(1, 1.0), (2, 2.0), (3, 9.0)], [(1, 2, 1.5), (3, 3, 9.0)])):
        draw()
        data = open(path, "rb").read()
        assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[16:24] == (1200).to_bytes(4, "big") + (600).to_bytes(4, "big")


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["template", "--mode", "real"]) == 0 and json.loads(capsys.readouterr().out)["mode"] == "real"
    path = tmp_path / "e.json"
    path.write_text(Experiment("cli", data=Data(horizon=200), model=Model(max_iter=5), output=Output(str(tmp_path / "out"))).to_json())
    assert cli.main(["run-experiment", str(path)]) == 0
    assert cli.main(["inspect", "--root", str(tmp_path / "out")]) == 0 and "cli  success" in capsys.readouterr().out
    assert cli.main(["run-real", "real_spy_daily_hard_switch"]) == 1  # no store


def test_menu_asks_and_runs():
    ran, said, answers = [], [], iter(["Data", "3", "wti:d", "store", "", "9", "2", "5", "surprise", "q", "4", "out", "1", "1", "y", "boom.toml", "3", "q", "5"])

    def run(argv):
        ran.append(argv)
        if "boom.toml" in argv:
            raise ValueError("no file\nmore")
        return 0

    assert menu.Menu(run, lambda prompt: next(answers), said.append).loop() == 0
    assert ran == [["show", "wti:d", "--store", "store", "-n", "10"], ["e2e", "--root", "out"], ["ingest", "--settings", "boom.toml", "--force"]]
    assert "no choice '9'" in said and "error: no file" in said


def test_every_flow_of_the_menu_is_a_command():
    m = menu.Menu(lambda argv: 0, lambda prompt: "1" if prompt.startswith("number") else "", lambda line: None)
    flows = [f for group in m.menus().values() for f in group.values()]
    commands = [cli.parser().parse_args(f()).command for f in flows]
    assert len(flows) == 13 and set(commands) >= {"ingest", "status", "show", "run-experiment", "run-real", "calibrate", "calibrate-scenario", "param-search", "inspect", "compare-runs", "compare-sim-vs-real", "generate-report", "e2e"}


def test_end_of_input_leaves_the_menu():
    def ask(prompt):
        raise EOFError

    assert menu.Menu(lambda argv: 1, ask, lambda line: None).loop() == 0


def test_scenario_calibration(spark, tmp_path, capsys):
    e = Experiment("c", data=Data("persistent_states", 500), output=Output(str(tmp_path)))
    _, empirical, params, checks = Runner(spark).calibrate(e)
    assert empirical["n"] == 350 and params["k"] == 2 and {c["field"] for c in checks} == {"variance", "q05", "q95", "abs_acf1", "sign_change_rate"}
    path = tmp_path / "c.json"
    path.write_text(e.to_json())
    assert cli.main(["calibrate-scenario", str(path)]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("c: synthetic:persistent_states") and lines[-1] == ("passed" if all(c["ok"] for c in checks) else "failed")
    with pytest.raises(ValueError):
        Runner(spark).calibrate(Experiment("r", "real", data=Data(asset="spy")))


def test_long_series_are_thinned_to_the_width(spark, monkeypatch):
    monkeypatch.setattr(plots, "BUCKETS", 10)
    rows = spark.range(1, 1001).select(F.lit("a").alias("series_id"), F.col("id").alias("t"), F.sin(F.col("id") / 7).alias("y"))
    line = plots.thinned(rows, F.col("y"), 1000)
    y = {t: np.sin(t / 7) for t in range(1, 1001)}
    expected = {f(range(b * 100 + 1, b * 100 + 101), key=y.get) for b in range(10) for f in (min, max)}
    assert [t for t, _ in line] == sorted(expected) and all(v == pytest.approx(y[t]) for t, v in line)
    assert len(plots.thinned(rows.where("t <= 8"), F.col("y"), 8)) == 8
    assert plots.marks(rows.where("t IN (5, 7, 250, 999)").select("t"), 1000) == [5, 250, 999]
    parts = rows.select("t", "y", F.when(F.col("t") < 50, 0).when(F.col("t") < 60, 1).otherwise(2).alias("segment_index"))
    assert [(a, b) for a, b, _ in plots.segment_means(parts, 1000)] == [(60, 1000)]
