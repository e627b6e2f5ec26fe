"""Small inputs and outputs: TOML settings, event catalogues, frozen models, and a run's JSON, CSV and table files."""

from __future__ import annotations

import json
import math
import os
import re
import tomllib
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import Params
from .vendor import parse_series

EVENT_SCHEMA = "id string, event_type string, label string, asset_scope string, anchor struct<Point: struct<at: timestamp_ntz>, Window: struct<start: timestamp_ntz, end: timestamp_ntz>>"


@dataclass
class Settings:
    api_key: str = ""
    per_minute: int = 75
    base_url: str = ""
    store: str = "data/prices"
    series: list[tuple[str, str]] = field(default_factory=list)


def read_settings(path: str) -> Settings:
    """From TOML with sections vendor (api_key, rate_limit_per_minute, base_url), store (path) and ingest (series)."""
    with open(path, "rb") as f:
        got = tomllib.load(f)
    vendor, wanted = got.get("vendor", {}), got.get("ingest", {}).get("series", [])
    series = [parse_series(s if isinstance(s, str) else f"{s['commodity']}:{s.get('interval', '')}") for s in wanted]
    return Settings(vendor.get("api_key", ""), int(vendor.get("rate_limit_per_minute", 75)), vendor.get("base_url", ""), got.get("store", {}).get("path", "data/prices"), series)


def read_events(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    """Proxy events as (series_id, id, event_type, label, kind, start, end); no path gives none, a missing file is an error."""
    if not path:
        return spark.createDataFrame([], "series_id string, id string, event_type string, label string, kind string, start timestamp_ntz, end timestamp_ntz")
    rows = spark.read.schema(EVENT_SCHEMA).option("multiLine", True).json(path)
    point = F.col("anchor.Point.at")
    kind = F.when(point.isNotNull(), F.lit("point")).otherwise(F.lit("window"))
    return rows.select(F.lit(series_id).cast("string").alias("series_id"), "id", "event_type", "label", kind.alias("kind"), F.coalesce(point, F.col("anchor.Window.start")).alias("start"), F.col("anchor.Window.end").alias("end"))


def write_params(path: str, p: Params) -> None:
    write_json(path, p.row())


def read_params(path: str) -> Params:
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    return Params(got["pi"], got["transition"], got["means"], got["variances"]).check()


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [_plain(v) for v in x]
    if isinstance(x, np.generic):
        return _plain(x.item())
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if isinstance(x, str | int | float | bool | None) else str(x)


def write_json(path: str, value) -> None:
    """Pretty JSON; what isn't finite becomes null."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    Path(path).write_text(json.dumps(_plain(value), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def write_csv(path: str, header: list[str], rows, decimals: int = 8) -> None:
    """Result tables, a row at a time; floats with so many decimals, null as nothing."""

    def cell(x) -> str:
        if x is None:
            return ""
        if isinstance(x, float):
            return f"{x:.{decimals}f}"
        text = str(x)
        return '"' + text.replace('"', '""') + '"' if re.search(r'[",\n]', text) else text

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for r in chain([header], rows):
            f.write(",".join(map(cell, r)) + "\n")


def safe_name(text: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_-]", "_", text)).strip("_") or "run"


class MetricsTable:
    """Rows of run metrics as Markdown, CSV or LaTeX: shares with three decimals, delays and thresholds with two."""

    def __init__(self, rows: list[dict], columns: list[str] | None = None):
        self.rows = rows
        self.columns = columns or list(dict.fromkeys(k for r in rows for k in r))

    def _cell(self, column: str, x, empty: str) -> str:
        if x is None or isinstance(x, float) and not math.isfinite(x):
            return empty
        if isinstance(x, float):
            return f"{x:.2f}" if "delay" in column or "threshold" in column else f"{x:.3f}"
        return str(x)

    def _lines(self, empty: str) -> list[list[str]]:
        return [[self._cell(c, r.get(c), empty) for c in self.columns] for r in self.rows]

    def to_markdown(self) -> str:
        lines = [self.columns, ["---"] * len(self.columns), *self._lines("")]
        return "".join("| " + " | ".join(r) + " |\n" for r in lines)

    def to_csv(self) -> str:
        return "".join(",".join(r) + "\n" for r in [self.columns, *self._lines("")])

    def to_latex(self) -> str:
        def tex(x: str) -> str:
            return re.sub(r"([&%$#_{}])", r"\\\1", x)

        body = "".join(" & ".join(map(tex, r)) + r" \\" + "\n" for r in self._lines("--"))
        head = " & ".join(map(tex, self.columns)) + r" \\" + "\n"
        return f"\\begin{{tabular}}{{{'l' * len(self.columns)}}}\n\\hline\n{head}\\hline\n{body}\\hline\n\\end{{tabular}}\n"
