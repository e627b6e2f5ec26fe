"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the longest sequence are cut into full sequences and a rest; nothing is dropped. The
pieces of a shard are placed by best fit, long ones first. When no open bin has room, the bin opened
is the one whose cost for each token that it may come to hold is least, given the pieces still
waiting; afterwards each bin becomes the shortest permitted length that holds its contents. Shards try
the opening rule with each permitted length as the longest one opened, and keep the cheapest result.

Documents are dealt to shards by a hash of their ids, about shard_rows to each, so no key is hot
and a task holds integers only; a lost task is packed again alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import need, quoted, schema, word_count

LENGTHS = (512, 1024, 2048, 4096, 8192)


def default_cost(length: int) -> float:
    """Work of a training sequence: linear layers, and attention that grows with the square."""
    return length + length * length / 16384 + 16


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...], costs: tuple[float, ...], longest: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(bin of each piece, length of each bin, cost). sizes: descending, each at most the longest permitted length."""
    below = np.concatenate((np.cumsum(sizes[::-1])[::-1], [0]))  # tokens from here on
    ascending = sizes[::-1]
    bins, fill, room = np.empty(len(sizes), np.int64), [], []
    by_room: dict[int, list[int]] = {}
    mask = 0
    for i, size in enumerate(sizes.tolist()):
        fits = mask >> size
        if fits:
            least = size + (fits & -fits).bit_length() - 1
            at = by_room[least]
            b = at.pop()
            if not at:
                mask &= ~(1 << least)
        else:
            allowed = [j for j, x in enumerate(lengths) if x >= size and (x <= longest or x == min(y for y in lengths if y >= size))]

            def unit(j: int) -> float:
                """Cost for each token, if what still fits comes in."""
                free = lengths[j] - size
                waiting = below[max(i + 1, len(sizes) - int(np.searchsorted(ascending, free, "right")))]
                return costs[j] / (size + min(free, int(waiting)))

            j = min(allowed, key=lambda j: (unit(j), lengths[j]))
            b, least = len(fill), lengths[j]
            fill.append(0)
            room.append(0)
        bins[i] = b
        fill[b] += size
        left = least - size
        by_room.setdefault(left, []).append(b)
        mask |= 1 << left
    chosen = np.searchsorted(np.array(lengths), np.array(fill, np.int64))
    return bins, np.array(lengths, np.int64)[chosen] if len(fill) else np.zeros(0, np.int64), float(np.array(costs)[chosen].sum()) if len(fill) else 0.0


def pack_shard(ids: list[int | None], sizes: list[int], lengths: tuple[int, ...], costs: tuple[float, ...]) -> list[tuple]:
    """Rows (id, n_tokens, piece, piece_start, piece_length, bin, capacity, bin_used, bin_offset) of one shard."""
    top, pieces = lengths[-1], []
    for k, n in enumerate(sizes):
        for p in range(max(1, -(-n // top))):
            pieces.append((k, p, p * top, min(top, n - p * top)))
    placed = [x for x in pieces if x[3]]
    placed.sort(key=lambda x: (-x[3], ids[x[0]] is None, ids[x[0]] or 0, x[1], x[0]))
    order = np.array([x[3] for x in placed], np.int64)
    runs = [best_fit(order, lengths, costs, longest) for longest in lengths]
    bins, kinds, _ = min(runs, key=lambda r: r[2])
    used = np.zeros(len(kinds), np.int64)
    out = []
    for (k, p, start, n), b in zip(placed, bins.tolist()):
        out.append([ids[k], sizes[k], p, start, n, b, int(kinds[b]), 0, int(used[b])])
        used[b] += n
    for row in out:
        row[7] = int(used[row[5]])
    out += [[ids[k], sizes[k], p, start, 0, None, None, None, None] for k, p, start, n in pieces if not n]
    return out


PACKED = schema(id="long", n_tokens="long", piece="long", piece_start="long", piece_length="long", bin_id="long", capacity="long", bin_used="long", bin_offset="long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, lengths: tuple[int, ...] = LENGTHS, cost=default_cost, shard_rows: int = 20_000) -> DataFrame:
    """One row for each piece of each row of docs: (id, n_tokens, piece, piece_start, piece_length, bin_id, capacity, bin_used, bin_offset).

    n_tokens is the value of size_col, or else the number of words of the text (null: 0). Pieces of a
    document are full sequences and a rest; bins hold whole pieces. A document without tokens has
    one row with piece 0 of length 0 and no bin. Rows with one id, or without id, are packed each.
    An empty table gives an empty table. Other columns are ignored.
    """
    need(docs, (id_col, size_col or text_col), "pack")
    lengths = tuple(sorted(lengths))
    costs = tuple(float(cost(x)) for x in lengths)
    size = F.greatest(F.coalesce(quoted(size_col).cast("long"), F.lit(0)), F.lit(0)) if size_col else word_count(quoted(text_col))
    shards = max(1, -(-docs.count() // shard_rows))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), size.alias("n")).withColumn("shard", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("n"))), F.lit(shards)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if ids:
                got = pack_shard(ids, sizes, lengths, costs)
                for row in got:
                    if row[5] is not None:
                        row[5] += now << 32
                for a in range(0, len(got), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got[a : a + 20_000])], PACKED.names)

        for batch in batches:
            for shard, i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if shard != now:
                    yield from done()
                    now, ids, sizes = shard, [], []
                ids.append(i)
                sizes.append(n)
        yield from done()

    out = rows.select("shard", "id", "n").repartition("shard").sortWithinPartitions("shard", F.desc("n"), "id").mapInArrow(run, PACKED)
    return out.withColumnRenamed("id", id_col)
