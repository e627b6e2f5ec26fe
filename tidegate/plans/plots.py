"""PNG plots of 1200 x 600 without a plotting library: a canvas in numpy and an encoder on zlib.

Lines are lists of (t, value); a series longer than the canvas is thinned first, in Spark, so what a plot takes to the driver is bounded by its width.
"""

from __future__ import annotations

import os
import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, MARGIN = 1200, 600, 40
#: Colours of regimes and lines.
COLOURS = ((31, 119, 180), (255, 127, 14), (44, 160, 44), (214, 39, 40), (148, 103, 189))
ALARM, TRUTH, GREY = (214, 39, 40), (44, 160, 44), (200, 200, 200)


class Canvas:
    def __init__(self, title: str, x: tuple[float, float], y: tuple[float, float]):
        self.title, self.x, self.y = title, x, y
        self.pixels = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)
        for f in np.linspace(0, 1, 6):
            r, c = int(MARGIN + f * (HEIGHT - 2 * MARGIN)), int(MARGIN + f * (WIDTH - 2 * MARGIN))
            self.pixels[r, MARGIN : WIDTH - MARGIN] = 235
            self.pixels[MARGIN : HEIGHT - MARGIN, c] = 235
        self.pixels[HEIGHT - MARGIN, MARGIN : WIDTH - MARGIN] = 0
        self.pixels[MARGIN : HEIGHT - MARGIN, MARGIN] = 0

    def _place(self, xs, ys) -> tuple[np.ndarray, np.ndarray]:
        def scaled(v, span, low, high):
            share = (np.asarray(v, float) - span[0]) / ((span[1] - span[0]) or 1.0)
            return np.clip(np.rint(low + np.clip(share, 0, 1) * (high - low)), 0, max(low, high)).astype(int)

        return scaled(xs, self.x, MARGIN, WIDTH - MARGIN), scaled(ys, self.y, HEIGHT - MARGIN, MARGIN)

    def line(self, xs, ys, colour=COLOURS[0]) -> None:
        ok = np.isfinite(np.asarray(ys, float))
        c, r = self._place(np.asarray(xs)[ok], np.asarray(ys, float)[ok])
        for c0, r0, c1, r1 in zip(c[:-1], r[:-1], c[1:], r[1:]):
            n = max(abs(c1 - c0), abs(r1 - r0), 1) + 1
            self.pixels[np.linspace(r0, r1, n).astype(int), np.linspace(c0, c1, n).astype(int)] = colour

    def verticals(self, xs, colour) -> None:
        c, _ = self._place(xs, np.zeros(len(xs)))
        self.pixels[MARGIN : HEIGHT - MARGIN, c] = colour

    def bars(self, xs, heights, width: float, colour=COLOURS[0]) -> None:
        for x, h in zip(xs, heights):
            c, r = self._place([x - width / 2, x + width / 2], [h, h])
            self.pixels[r[0] : HEIGHT - MARGIN, c[0] : c[1] + 1] = colour

    def save(self, path: str) -> None:
        def chunk(kind: bytes, body: bytes) -> bytes:
            return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

        rows = np.zeros((HEIGHT, 1 + 3 * WIDTH), np.uint8)
        rows[:, 1:] = self.pixels.reshape(HEIGHT, -1)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, HEIGHT, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"Title\0" + self.title.encode("latin-1", "replace")) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b""))


def _span(values) -> tuple[float, float]:
    v = np.asarray(values, float)
    v = v[np.isfinite(v)]
    return (float(v.min()), float(v.max())) if len(v) and v.min() < v.max() else (float(v[0]) - 1 if len(v) else 0.0, float(v[0]) + 1 if len(v) else 1.0)


#: Buckets of time that a line is thinned to, somewhat more than the canvas has columns.
BUCKETS = 2 * WIDTH


def bucket(n: int) -> Column:
    return F.floor((F.col("t") - 1) * BUCKETS / F.lit(max(n, 1)))


def thinned(rows: DataFrame, value: Column, n: int) -> list[tuple[int, float]]:
    """(t, value) of rows with t from 1 to n: all of a short series, the least and the greatest of each bucket of a long one."""
    rows = rows.select("t", value.alias("v"))
    if n > BUCKETS:
        ends = rows.groupBy(bucket(n)).agg(F.struct(F.min_by("t", "v").alias("t"), F.min("v").alias("v")).alias("a"), F.struct(F.max_by("t", "v").alias("t"), F.max("v").alias("v")).alias("b"))
        rows = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select("p.*").where("t IS NOT NULL")
    return sorted((r["t"], r["v"]) for r in rows.collect())


def marks(times: DataFrame, n: int) -> list[int]:
    """The first t of each bucket that has one."""
    return sorted(r["t"] for r in times.groupBy(bucket(n)).agg(F.min("t").alias("t")).collect())


def segment_means(segments: DataFrame, n: int) -> list[tuple[int, int, float]]:
    """(start, end, mean) of rows (segment_index, t, y), of many that start in a bucket the longest."""
    each = segments.groupBy("segment_index").agg(F.min("t").alias("t"), F.max("t").alias("end"), F.avg("y").alias("mean"))
    one = each.groupBy(bucket(n)).agg(F.max_by(F.struct("t", "end", "mean"), F.struct(F.col("end") - F.col("t"), -F.col("t"))).alias("s"))
    return sorted(tuple(r[0]) for r in one.select("s").collect())


def signal_with_alarms(path: str, n: int, line, alarms, truth=()) -> None:
    t, y = zip(*line) if line else ((), ())
    c = Canvas("Signal and alarms", (1, max(2, n)), _span(y))
    c.verticals(list(truth), TRUTH)
    c.line(t, y)
    c.verticals(list(alarms), ALARM)
    c.save(path)


def detector_scores(path: str, n: int, line, threshold: float, alarms) -> None:
    t, scores = zip(*line) if line else ((), ())
    c = Canvas("Detector scores", (1, max(2, n)), _span([*scores, threshold]))
    c.line(t, scores)
    c.line([1, max(2, n)], [threshold, threshold], GREY)
    c.verticals(list(alarms), ALARM)
    c.save(path)


def regime_posteriors(path: str, n: int, lines) -> None:
    """A line for each regime."""
    c = Canvas("Regime posteriors", (1, max(2, n)), (0, 1))
    for j, line in enumerate(lines):
        c.line(*(zip(*line) if line else ((), ())), COLOURS[j % len(COLOURS)])
    c.save(path)


def delay_distribution(path: str, delays) -> None:
    values, counts = np.unique(np.asarray(list(delays), int), return_counts=True)
    c = Canvas("Detection delays", _span([*values - 0.5, *values + 0.5]), (0, max([1, *counts])))
    c.bars(values, counts, 0.8)
    c.save(path)


def segmentation(path: str, n: int, line, segments) -> None:
    """The signal with each segment's mean; segments are (start, end, mean)."""
    t, y = zip(*line) if line else ((), ())
    c = Canvas("Segmentation", (1, max(2, n)), _span(y))
    c.line(t, y, GREY)
    for start, end, mean in segments:
        c.line([start, end], [mean, mean], COLOURS[1])
    c.verticals([s for s, _, _ in segments if s > 1], ALARM)
    c.save(path)
