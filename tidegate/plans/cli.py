"""`python -m tidegate.plans.cli COMMAND`: runs, searches, calibration, the store and reports."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate, features, search
from ..operators.clean import SERIES
from ..sources import files, store, vendor
from . import config, menu, registry
from .runner import Runner, compare_runs, read_runs, summary_row


def session() -> SparkSession:
    return SparkSession.builder.appName("tidegate").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def prices_of(spark: SparkSession, path: str | None) -> DataFrame | None:
    return None if path is None else store.Store(spark, path).prices.select(F.col("symbol").alias(SERIES), "ts", "value")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegate")
    sub = p.add_subparsers(dest="command")

    def add(name: str, what: str, *args) -> None:
        s = sub.add_parser(name, help=what)
        for flags, options in args:
            s.add_argument(*flags, **options)

    exp = (("experiment",), {"help": "a registered label, or the path of a JSON configuration"})
    stored = (("--store",), {"help": "folder of the price store"})
    root = (("--root",), {"default": "runs"})
    add("e2e", "run all registered synthetic experiments and tabulate them", root)
    add("run-experiment", "run one experiment", exp, stored, (("--dry-run",), {"action": "store_true"}))
    add("run-real", "run one experiment on real prices", exp, stored)
    add("run-batch", "run several experiments", (("experiments",), {"nargs": "+"}), stored, (("--stop-on-error",), {"action": "store_true"}))
    add("param-search", "score a detector grid", exp, stored, (("--top",), {"type": int, "default": 10}))
    add("optimize", "search, then run the best with all outputs", exp, stored, (("--top",), {"type": int, "default": 10}), (("--models",), {"action": "store_true", "help": "search numbers of regimes and features too"}))
    add("calibrate", "calibrate a scenario to an asset", (("asset",), {}), (("--store",), {"required": True}), (("--strategy",), {"choices": ("summary", "quick_em"), "default": "summary"}), (("--k",), {"type": int, "default": 2}), root)
    add("calibrate-scenario", "calibrate to the train share of a synthetic experiment, and compare", exp)
    add("compare-runs", "a table of the runs below a folder", root, (("--format",), {"choices": ("md", "csv", "tex"), "default": "md"}))
    add("compare-sim-vs-real", "metric by metric, real run less simulated one", (("sim",), {}), (("real",), {}))
    add("inspect", "list the runs below a folder", root)
    add("status", "what the store holds", (("--store",), {"required": True}))
    add("show", "the newest prices of a series", (("series",), {}), (("--store",), {"required": True}), (("-n",), {"type": int, "default": 10}))
    add("ingest", "fetch the configured series into the store", (("--settings",), {"default": "config.toml"}), (("--force",), {"action": "store_true"}), (("--payloads",), {"help": "folder of saved payloads, instead of the network"}))
    add("generate-report", "run a saved configuration again with all outputs", (("snapshot",), {}), stored)
    add("template", "print a configuration", (("--mode",), {"choices": ("synthetic", "real", "sim_to_real"), "default": "synthetic"}))
    add("menu", "choose commands interactively; the same as no command")
    add("help", "this list")
    return p


def experiment(name: str) -> config.Experiment:
    known = registry.registry()
    return known[name] if name in known else config.load(name)


def calibration_report(e: config.Experiment, empirical: dict, params: dict, checks: list[dict]) -> list[str]:
    """Lines on a calibration: the summary it aims at, the parameters, each field's check and the verdict."""
    figures = [f"  {k} = {v:.6f}" if isinstance(v, float) else f"  {k} = {v}" for k, v in empirical.items() if k != SERIES]
    regimes = [f"  regime {j}: mean {params['means'][j]:.6f}, variance {params['variances'][j]:.6f}, {d:.1f} bars" for j, d in enumerate(params["expected_durations"])]
    fields = [f"  {c['field']}: real {c['real']:.6f}, synthetic {c['synthetic']:.6f}, error {c['error']:.4f} of {c['tolerance']:.2f}{'' if c['ok'] else ', beyond'}" for c in checks]
    return [f"{e.label}: synthetic:{e.data.scenario}, {e.feature.label('')}, horizon {e.data.horizon}", *figures, *regimes, *fields, "passed" if all(c["ok"] for c in checks) else "failed"]


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    say = print
    if a.command in (None, "menu"):
        return menu.Menu(main).loop()
    if a.command == "help":
        p.print_help()
        return 0
    if a.command == "template":
        say(registry.template(a.mode).to_json())
        return 0
    if a.command == "compare-runs":
        table = compare_runs(a.root)
        say({"md": table.to_markdown, "csv": table.to_csv, "tex": table.to_latex}[a.format]())
        return 0
    if a.command == "inspect":
        for r in read_runs(a.root):
            say(f"{r['folder']}  {r['label']}  {r['status']}  alarms {r['n_alarms']}")
        return 0
    if a.command == "compare-sim-vs-real":
        sim, real = (json.load(open(f"{d}/summary.json", encoding="utf-8")) for d in (a.sim, a.real))
        rows = [{"metric": k, "sim": sim[k], "real": real[k], "gap": real[k] - sim[k]} for k in sim if isinstance(sim[k], int | float) and isinstance(real.get(k), int | float)]
        say(files.MetricsTable(rows, ["metric", "sim", "real", "gap"]).to_markdown())
        return 0
    spark = session()
    if a.command in ("status", "show", "ingest"):
        if a.command == "ingest":
            settings = files.read_settings(a.settings)
            spark.dataSource.register(vendor.VendorSource)

            def fetch(symbol: str, how: str) -> DataFrame:
                options = {"symbol": symbol, "interval": how, "per_minute": str(settings.per_minute)} | ({"path": a.payloads} if a.payloads else {"url": settings.base_url, "api_key": settings.api_key})
                return vendor.decode(spark.read.format("vendor").options(**options).load())

            for what in store.Store(spark, settings.store).prepare():
                say(what)
            now = spark.sql("SELECT cast(current_timestamp() AS timestamp_ntz) AS t").first()["t"]
            got = store.Store(spark, settings.store).ingest(settings.series, fetch, str(now), a.force)
            for (symbol, how), what in got.items():
                say(f"{symbol} {how}: {what}")
            return int(any(w.startswith("failed") for w in got.values()))
        s = store.Store(spark, a.store)
        if a.command == "status":
            s.status().orderBy("symbol", "interval").show(200, False)
        else:
            store.newest(s.prices, *vendor.parse_series(a.series), a.n).show(a.n, False)
        return 0
    runner = Runner(spark, prices_of(spark, getattr(a, "store", None)))
    if a.command == "calibrate-scenario":
        for line in calibration_report(*runner.calibrate(experiment(a.experiment))):
            say(line)
        return 0
    if a.command == "calibrate":
        obs = features.numbered(features.returns(runner.prices.where(F.col(SERIES) == a.asset)))
        m = calibrate.Mapping(k=a.k, strategy=a.strategy)
        params, simulated, checks = calibrate.workflow(obs, m)
        folder = f"{a.root}/calibration/{files.safe_name(a.asset)}"
        files.write_json(f"{folder}/calibrated_scenario.json", params.first().asDict(True))
        files.write_json(f"{folder}/calibration_summary.json", [r.asDict() for r in checks.collect()])
        files.write_json(f"{folder}/synthetic_vs_empirical_summary.json", {"empirical": calibrate.empirical_summary(obs).first().asDict(), "synthetic": calibrate.empirical_summary(simulated).first().asDict()})
        checks.show(20, False)
        return 0
    if a.command == "e2e":
        results = runner.batch([replace(e, output=replace(e.output, root=a.root)) for e in registry.registry().values() if e.mode == "synthetic" and not e.model.frozen])
        text = files.MetricsTable([summary_row(r) for r in results]).to_markdown()
        with open(f"{a.root}/metrics_table.md", "w", encoding="utf-8") as f:
            f.write(text)
        say(text)
    elif a.command == "run-batch":
        results = runner.batch([experiment(x) for x in a.experiments], a.stop_on_error)
        files.write_json(f"{experiment(a.experiments[0]).output.root}/batch_summary.json", [summary_row(r) for r in results])
    elif a.command in ("param-search", "optimize"):
        e = experiment(a.experiment)
        models = search.model_grid(e.data.frequency != "daily") if getattr(a, "models", False) else None
        ranked = runner.optimize(e, search.REAL_GRIDS[e.detector.kind], models)
        lines = [{"rank": i, "score": s, "k": x.model.k, "feature": x.feature.label(""), "threshold": x.detector.threshold, "required": x.detector.required, "cooldown": x.detector.cooldown} for i, (s, x) in enumerate(ranked[: a.top], 1)]
        text = files.MetricsTable(lines).to_markdown()
        say(text)
        if a.command == "param-search":
            return 0
        results = [runner.run(ranked[0][1])]
        files.write_json(f"{results[0].folder}/search_report.json", lines)
        with open(f"{results[0].folder}/search_summary.txt", "w", encoding="utf-8") as f:
            f.write(text)
    else:
        e = config.load(a.snapshot) if a.command == "generate-report" else experiment(a.experiment)
        if a.command == "generate-report":
            e = replace(e, deterministic_id=False, output=replace(e.output, json=True, csv=True, traces=True, plots=True))
        if getattr(a, "dry_run", False):
            e = replace(e, mode="dry_run")
        if a.command == "run-real" and e.mode == "synthetic":
            raise SystemExit("this experiment has no real series")
        results = [runner.run(e)]
    for r in results:
        say(f"{r.label}: {r.status}" + (f" in {r.stage}: {r.message}" if r.message else "") + f" {r.folder or ''}")
    return int(any(r.status == "failed" for r in results))


if __name__ == "__main__":
    sys.exit(main())
