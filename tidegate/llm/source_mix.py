"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is f times its size gives every document floor(f) times, and one more copy
with probability f - floor(f). Which documents get that copy is drawn by the cube method: the
probabilities of three documents at a time move along the one direction that keeps both the tokens
and the number of documents, until one of them is 0 or 1 and the next document takes its place.

That flight runs in chunks of a bounded number of documents, dealt by a hash of the id, so a source
of any size spreads over tasks. At most two documents of a chunk stay fractional; these go into a
flight of their own, and so on, until each source has one chunk. What that leaves is the landing:
the at most two documents of a source get the copies that bring its tokens nearest to the target, and
one document of that last chunk may still change places with another for the same end.
Long documents fly first, so that short ones are left. All draws come from hashes and a seed.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import Scratch, join_small, need, quoted, schema, word_count

CHUNK = 4096
EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Target of each source: the sources by code point, null last, have the weights in turn; no target is beyond cap times
    the source's size, and what is cut off goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in order if s in open_)
        full = [s for s in order if s in open_ and rest * weight[s] / total > cap * sizes[s]]
        if not full:
            return out | {s: rest * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
            open_.discard(s)
        rest -= sum(out[s] for s in full)
    return out


def flight(sizes: list[int], probs: list[float], seed: list[int]) -> list[float]:
    """Probabilities after the flight: all but at most two are 0 or 1, with the sums of probabilities and of probable sizes as before."""
    p = list(probs)
    draw = iter(np.random.Generator(np.random.PCG64(seed)).random(len(p) + 8).tolist())
    waiting = iter([i for i, x in enumerate(p) if EPS < x < 1 - EPS])
    held: list[int] = []
    while True:
        while len(held) < 3 and (i := next(waiting, None)) is not None:
            held.append(i)
        if len(held) < 2:
            return p
        if len(held) == 3:
            a, b, c = (sizes[i] for i in held)
            u = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
        elif sizes[held[0]] == sizes[held[1]]:
            u = (1, -1)
        else:
            return p
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u) if x)
        step = up if next(draw) * (up + down) < down else -down
        for i, x in zip(held, u):
            p[i] += step * x
            p[i] = 0.0 if p[i] < EPS else 1.0 if p[i] > 1 - EPS else p[i]
        held = [i for i in held if 0 < p[i] < 1]


def landing(sizes: list[int], probs: list[float]) -> list[float]:
    """0 or 1 for the few that the flight left, so that the tokens come nearest to what was meant; of a tie, the number of documents too."""
    left = [i for i, x in enumerate(probs) if 0 < x < 1]
    meant, count = sum(sizes[i] * probs[i] for i in left), sum(probs[i] for i in left)
    best = min(product((0.0, 1.0), repeat=len(left)), key=lambda x: (abs(sum(sizes[i] * v for i, v in zip(left, x)) - meant), abs(sum(x) - count), x))
    out = list(probs)
    for i, v in zip(left, best):
        out[i] = v
    return out


def settle(sizes: list[int], meant: float, drawn: list[float]) -> list[float]:
    """The draw with one document in, one out, or one for another, if that brings the tokens nearer to what was meant.

    Long documents that the flight leaves can't land near a small source's target by themselves."""
    missing = meant - sum(s * x for s, x in zip(sizes, drawn))
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    out_, in_ = [i for i in order if drawn[i] == 0], [i for i in order if drawn[i] == 1]
    best: tuple[float, int, tuple[int, ...]] = (abs(missing), 0, ())
    waiting = [sizes[i] for i in out_]
    for leaves in (None, *in_):
        want = missing + (sizes[leaves] if leaves is not None else 0)
        at = bisect_left(waiting, want)
        for enters in (None, *out_[max(0, at - 1) : at + 1]):
            moved = tuple(i for i in (leaves, enters) if i is not None)
            best = min(best, (abs(want - (sizes[enters] if enters is not None else 0)), len(moved), moved))
    got = list(drawn)
    for i in best[2]:
        got[i] = 1.0 - got[i]
    return got


def _fly(seed: int, level: int, last: bool):
    """Flights of a partition sorted by (source number, chunk, size down, hash, id); holds one chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                sizes, probs = table["size"].to_pylist(), table["prob"].to_pylist()
                got = flight(sizes, probs, [seed, level, *now])
                got = settle(sizes, sum(s * p for s, p in zip(sizes, probs)), landing(sizes, got)) if last else got
                yield from table.set_column(table.schema.get_field_index("prob"), "prob", pa.array(got, pa.float64())).to_batches()

        for batch in batches:
            number, chunk = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("number", "chunk"))
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(number) != 0) | (np.diff(chunk) != 0)) + 1, [len(number)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if now != (int(number[a]), int(chunk[a])):
                    yield from done()
                    now, held = (int(number[a]), int(chunk[a])), []
                held.append(batch.slice(a, b - a))
        yield from done()

    return run


FLYING = schema(id="long", size="long", number="long", prob="double", draw="long", chunk="long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, draw_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of docs; size: words of the text, null: 0.

    Each row is taken floor(f) or floor(f) + 1 times, where f <= cap is its source's target over its
    size, so none exceeds ceil(cap) times its size. Sources without words have target 0. A null source is a
    source; texts that are null or empty have size 0 and are drawn like others. Rows with one id are
    rows of their own. Very long texts are counted whole. An empty table gives an empty table. Other columns are ignored.
    Draws go by a hash of the id, or of draw_col if one is given (what is in a row, say, where ids are only places); rows that are alike in that and in
    size are in the order of their ids. The targets need each source's sum: one row a source comes to the driver, which is bounded by the number
    of sources, not of documents.
    """
    need(docs, (id_col, text_col, source_col, *([draw_col] if draw_col else [])), "source_mix")
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = scratch.table(docs.select(quoted(id_col).cast("long").alias("id"), quoted(source_col).cast("string").alias("source"), word_count(quoted(text_col)).alias("size"), quoted(draw_col or id_col).cast("long").alias("draw")), "sized")
    sums = {r["source"]: (int(r["size"]), int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    goal = targets({s: x[0] for s, x in sums.items()}, weights, share, cap)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    plan = []
    for number, s in enumerate(order):
        ratio = goal[s] / sums[s][0] if sums[s][0] else 0.0
        base = min(math.floor(ratio + EPS), math.ceil(cap))
        plan.append((s, number, sums[s][0], float(goal[s]), base, min(1.0, max(0.0, ratio - base)), max(1, -(-sums[s][1] // CHUNK))))
    fields = T.StructType([T.StructField("s", T.StringType()), T.StructField("number", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("base", T.IntegerType()), T.StructField("prob", T.DoubleType()), T.StructField("chunks", T.LongType())])
    plan_df = spark.createDataFrame(plan, fields)
    rows = join_small(sized, plan_df.select("s", "number", "prob", "chunks"), "source", "s", len(plan)).select("id", "size", "number", "prob", "draw", "chunks")
    last, settled, level = all(p[-1] == 1 for p in plan), [], 0
    while True:
        h = F.xxhash64("draw", F.lit(seed + level))
        dealt = rows.withColumn("chunk", F.pmod(h, F.col("chunks"))).repartition("number", "chunk").sortWithinPartitions("number", "chunk", F.desc("size"), h, "id")
        flown = scratch.table(dealt.select(*FLYING.names).mapInArrow(_fly(seed, level, last), FLYING), f"level-{level}")
        settled.append(flown.where("prob = 0 OR prob = 1"))
        if last:
            break
        rest = flown.where("prob > 0 AND prob < 1").select("id", "size", "number", "prob", "draw")
        left = rest.groupBy("number").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
        last = left.where("chunks > 1").limit(1).count() == 0
        rows, level = rest.join(left, "number"), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = join_small(out.select("id", "size", "number", "prob"), plan_df.drop("prob", "chunks").withColumnRenamed("number", "__number"), "number", "__number", len(plan))
    copies = (F.col("base") + F.col("prob")).cast("int")
    return out.select(F.col("id").alias(id_col), F.col("s").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
