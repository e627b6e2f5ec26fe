"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct k-word shingles. Shingles are hashed into groups; the vector of
group counts is the document's point. For two points the sum of the coordinate minima bounds the
number of common shingles from above, and against an R-tree node the same sum with the node's upper
corner bounds it for the whole subtree; what survives is verified on the full sets.

One tree over a corpus would be both unbounded and, in so many dimensions, hardly selective, so the
tree is a forest whose trunks no link can cross:

1. Equal sets fold into one representative, the smallest id (a partial aggregate over digests). Copies are still
   read and routed where they are, but no text of theirs moves.
2. A set of size a and a partner of size b in a..a/t differ in at most r shingles. Split by hash into
   more than r groups, two linked sets agree wholly on at least one group. So each document is
   routed by the hashes of its groups' contents (with as many groups as its size class asks for), and
   sets that share a route fall into one *cell*: a connected component of the routes. No link leaves
   a cell; each representative is in one cell only, so its text moves once. Routes travel as packed
   arrays of ten bytes each, and a task sends one row for a route however many of its documents have it.
3. In each cell an R-tree over count vectors gives the pairs that may be linked; only pairs that
   aren't yet connected are verified, so a group of m copies costs about m verifications.
4. A cell beyond the bounds first loses the documents that can't have a link: a link takes a share t of a set's
   shingles, so a set that has fewer in common with all others together is out, before its text moves. What is
   left beyond the bounds is dealt into blocks. Each block also gets the cell's pivots, which
   connects groups of near copies across blocks; only where a cell still falls into several
   components, pairs of blocks are compared too, in rounds, so that a text has few copies at a time. Nothing is capped.

Groups that hold few shingles (empty ones above all), or only such as many documents have (of a passage that
is everywhere), would route unrelated texts together. With w groups more than r+1, at least w+1
groups agree; a document with at most w such weak groups has a strong group among them with every
partner, so it isn't routed by weak ones; others use all. Which shingles are common is read off a
bounded sample of the documents. It only decides which keys are used, for all documents alike, and never loses a link.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _vec
from ._base import Scratch, join_small, need, quoted, release, schema
from ._components import connected_components

#: Ratio of a size class's greatest to its least size; deviations by which weak groups should stay below the slack.
CLASS_RATIO, SPARE = 1.5, 4.0


def linked(inter: int, a: int, b: int, per_cent: int) -> bool:
    return a > 0 and b > 0 and 100 * inter >= per_cent * (a + b - inter)


def needed(a, b, per_cent: int):
    """Least intersection of linked sets of these sizes: 100 i >= p (a + b - i)."""
    return -((-per_cent * (a + b)) // (100 + per_cent))


@functools.cache
def size_class(c: int, per_cent: int) -> tuple[int, int, int, int, int]:
    """(least size, greatest size, groups, slack w, least count of a strong group) of class c, for pairs whose smaller set is in it."""
    lo = max(1, math.ceil(CLASS_RATIO**c)) if c else 1
    hi = max(lo, math.ceil(CLASS_RATIO ** (c + 1)) - 1)
    r = 0
    for a in {lo, hi, *range(lo, hi, max(1, (hi - lo) // 400))}:
        b_most = 100 * a // per_cent
        for b in {a, b_most, *range(a, b_most, max(1, (b_most - a) // 50))}:
            r = max(r, a + b - 2 * int(needed(a, b, per_cent)))
    r += (hi - lo) > 400  # between the sizes looked at it can be larger by one
    if r == 0:
        return lo, hi, 0, 0, 1

    def spare(w: int, s: int) -> float:
        """Standard deviations between the weak groups of the class's smallest sets and w."""
        h = r + 1 + w
        lam = lo / h
        p = sum(math.exp(-lam) * lam**i / math.factorial(i) for i in range(s))
        return (w + 0.5 - h * p) / math.sqrt(max(h * p * (1 - p), 1e-9))

    # Two shingles to a strong group if sets of the class then hardly ever have more than w weak ones, else one.
    for s in (2, 1):
        for w in range(2 * r + 3):
            if spare(w, s) >= SPARE:
                return lo, hi, r + 1 + w, w, s
    w = max(range(2 * r + 3), key=lambda x: spare(x, 1))
    s = 1
    return lo, hi, r + 1 + w, w, s


def classes_of(n: int, per_cent: int) -> list[int]:
    """Classes in which a set of n shingles may meet a partner: those of its own size and of smaller sets it may be linked with."""
    if n < 1:
        return []
    least = max(1, -((-per_cent * n) // 100))
    top = int(math.log(n, CLASS_RATIO)) + 1
    return [c for c in range(max(0, top - 4), top + 1) if size_class(c, per_cent)[0] <= n and size_class(c, per_cent)[1] >= least]


def routes(u: np.ndarray, per_cent: int, common: np.ndarray | None = None) -> np.ndarray:
    """Routing keys of a sorted set of hashes. common: hashes that don't make a group strong, the same for all documents."""
    out = []
    rare = np.arange(len(u) + 1)
    if common is not None and len(common) and len(u):
        known = common[np.minimum(np.searchsorted(common, u), len(common) - 1)] == u
        rare = np.concatenate(([0], np.cumsum(~known)))
    mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_vec.mix(u), dtype=np.uint64)))
    high = u >> np.uint64(32)
    for c in classes_of(len(u), per_cent):
        _, _, groups, w, strong = size_class(c, per_cent)
        if not groups:
            continue  # only equal sets can be linked
        at = np.searchsorted(high * np.uint64(groups) >> np.uint64(32), np.arange(groups + 1, dtype=np.uint64))
        counts = np.diff(at)
        keys = _vec.mix((mixed[at[1:]] - mixed[at[:-1]]) * np.uint64(0xA0761D6478BD642F) + np.arange(groups, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB) + counts.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3) + np.uint64(c * 2 + 1))
        weak = np.diff(rare[at]) < strong
        out.append(keys[~weak] if weak.sum() <= w else keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class CountTree:
    """A bulk-loaded R-tree over count vectors, searched by the overlap bound."""

    FAN = 16

    def __init__(self, sets: list[np.ndarray], per_cent: int, groups: int = 128):
        self.per_cent = per_cent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.points = np.zeros((len(sets), groups), np.int32)
        for i, s in enumerate(sets):
            self.points[i] = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        self.order = self._pack(np.arange(len(sets)))
        corners, least, most = self.points[self.order], self.sizes[self.order], self.sizes[self.order]
        self.levels = [(corners, least, most)]
        while len(corners) > self.FAN:
            cut = np.arange(0, len(corners), self.FAN)
            corners, least, most = np.maximum.reduceat(corners, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((corners, least, most))

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        """Order of the leaves: halves by the size or the coordinate that spreads most, cut at whole leaves."""
        out, stack = [], [rows]
        while stack:
            rows = stack.pop()
            if len(rows) <= self.FAN:
                out.append(rows)
                continue
            p = self.points[rows]
            spread = np.append(p.max(0) - p.min(0), np.ptp(self.sizes[rows]))
            axis = int(spread.argmax())
            key = self.sizes[rows] if axis == p.shape[1] else p[:, axis]
            rows = rows[np.argsort(key, kind="stable")]
            half = max(1, len(rows) // 2 // self.FAN) * self.FAN
            stack += [rows[half:], rows[:half]]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows that the bound lets through, in ascending order."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corners, least, most = self.levels[depth]
            least, most = least[at], most[at]
            # the partner's size that asks for least: the smallest in the subtree
            bound = np.minimum(np.minimum(corners[at], point).sum(1), np.minimum(most, size))
            at = at[(bound >= needed(size, least, self.per_cent)) & (bound > 0)]
            if depth:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return np.sort(self.order[at])


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        self.up[j] = i


def join_cell(ids: list[int], sets: list[np.ndarray], per_cent: int, known: list[int] | None = None, apart: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the documents of a cell as all its links do.

    known: components so far, which needn't be looked at again inside; apart: sides, if only pairs
    of different sides are wanted."""
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    union, first = Union(len(ids)), {}
    for i, j in enumerate(order):
        if known is not None:
            union.join(first.setdefault(known[j], i), i)
    sides = [apart[j] for j in order] if apart is not None else None
    tree, out = CountTree(sets, per_cent), []
    for i in range(len(ids)):
        for j in tree.search(tree.points[i], len(sets[i])).tolist():
            if j <= i or sides is not None and sides[i] == sides[j] or union.find(i) == union.find(j):
                continue
            a, b = sets[i], sets[j]
            if linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), per_cent):
                union.join(i, j)
                out.append((ids[i], ids[j]))
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Per document: its id, the number and a 128-bit digest of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest = [], []
            for u in _vec.shingle_sets(batch.column(1), k):
                n.append(len(u))
                digest.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], ["id", "n", "digest"])

    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).mapInArrow(run, schema(id="long", n="long", digest="binary"))


#: Routes that a task holds before it sends them on, and bits of a route that are sent. Two routes that fall together only make a cell larger.
HELD, SENT_BITS = 1_000_000, 48
#: A bucket gives one link at least for each of its documents that meets another; as many buckets for small inputs keep their number in proportion.
LEAST_BUCKETS = 128


def _pack_routes(k: int, per_cent: int, buckets: int, common: np.ndarray | None):
    """Documents to rows (bucket, low, width, payload, links): the distinct routes of a bucket with one document for each, and links between
    documents of this task that share one."""

    def rows_of(routes_: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        order = np.lexsort((ids, routes_))  # the smallest id of a route stands for it
        r, d = routes_[order], ids[order]
        first = np.ones(len(r), bool)
        first[1:] = r[1:] != r[:-1]
        rep = d[first][np.cumsum(first) - 1]
        same = ~first & (rep != d)
        links = np.unique(np.stack((d[same], rep[same]), 1), axis=0) if same.any() else np.zeros((0, 2), np.int64)
        r, d = r[first], d[first]
        cut = np.searchsorted((r >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24), np.arange(buckets + 1, dtype=np.uint64))
        of_link = np.searchsorted(np.sort(links[:, 0] % buckets), np.arange(buckets + 1))
        links = links[np.argsort(links[:, 0] % buckets, kind="stable")]
        for b in range(buckets):
            part, own, more = r[cut[b] : cut[b + 1]], d[cut[b] : cut[b + 1]], links[of_link[b] : of_link[b + 1]]
            if not len(part) and not len(more):
                continue
            low = int(own.min()) if len(own) else 0
            width = 4 if len(own) and int(own.max()) - low < 1 << 32 else 8
            short = np.ascontiguousarray(part.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : SENT_BITS // 8]
            yield b, low, width, short.tobytes() + (own - low).astype(f"<u{width}").tobytes(), more.astype("<i8").tobytes()

    names = ["bucket", "low", "width", "payload", "links"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            rows = list(rows_of(np.concatenate(held), np.concatenate(ids))) if held else []
            for a in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64]), kinds)], names)

        for batch in batches:
            for doc_id, u in zip(batch.column(0).to_pylist(), _vec.shingle_sets(batch.column(1), k)):
                got = routes(u, per_cent, common)
                if len(got):
                    held.append(got)
                    ids.append(np.full(len(got), doc_id, np.int64))
                    size += len(got)
                if size >= HELD:
                    yield from send()
                    held, ids, size = [], [], 0
        yield from send()
        held, ids = [], []
        _vec.trim()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by bucket to links (a, b) that connect all documents that share a route; holds one bucket."""
    now, routes_, ids, links = None, [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        if now is None:
            return
        r, d = np.concatenate(routes_), np.concatenate(ids)
        order = np.lexsort((d, r))
        r, d = r[order], d[order]
        first = np.ones(len(r), bool)
        first[1:] = r[1:] != r[:-1]
        rep = d[first][np.cumsum(first) - 1] if len(r) else d
        same = ~first & (rep != d)
        pairs = np.concatenate([np.stack((d[same], rep[same]), 1), *links])
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    size = SENT_BITS // 8
    for batch in batches:
        for bucket, low, width, payload, more in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if bucket != now:
                yield from done()
                now, routes_, ids, links = bucket, [], [], []
            n = len(payload) // (size + width)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :size] = np.frombuffer(payload, np.uint8, n * size).reshape(n, size)
            routes_.append(wide.view("<u8").ravel())
            ids.append(np.frombuffer(payload, f"<u{width}", n, n * size).astype(np.int64) + low)
            links.append(np.frombuffer(more, "<i8").reshape(-1, 2))
    yield from done()
    routes_, ids, links = [], [], []
    _vec.trim()


#: Documents of the sample that tells common shingles, and how many of them must have one.
SAMPLE_DOCS, COMMON_FROM = 4096, 3


def common_shingles(docs: DataFrame, id_col: str, text_col: str, k: int, folded: DataFrame) -> np.ndarray:
    """Sorted hashes that are in several documents of a sample of SAMPLE_DOCS different sets, those with the smallest hashes of their digests.

    The result is bounded by the sample; texts of more than 20,000 shingles aren't sampled."""
    some = folded.where("n <= 20000").select(F.col("rep").alias("id"), F.xxhash64("digest").alias("h")).orderBy("h", "id").limit(SAMPLE_DOCS).select("id")
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).join(F.broadcast(some), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in _vec.shingle_sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64))], ["s"])

    counts = texts.mapInArrow(run, schema(s="long")).groupBy("s").count().where(F.col("count") >= COMMON_FROM)
    return np.sort(counts.select("s").toArrow()["s"].to_numpy().astype(np.int64).view(np.uint64))


def bucket_count(shingles_: int) -> int:
    """Buckets for documents with so many shingles, those of copies included: copies that lie in different tasks send their routes each. There are
    about half as many routes as shingles, so a bucket has about HELD of them at most. Routes are dealt by their first 24 bits."""
    return max(LEAST_BUCKETS, min(shingles_ // (2 * HELD) + 1, 1 << 24))


def meetings(docs: DataFrame, id_col: str, text_col: str, k: int, per_cent: int, shingles_: int, common: np.ndarray | None = None) -> DataFrame:
    """Links (a, b) whose components are the cells; tasks take one bucket or several."""
    buckets = bucket_count(shingles_)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets if buckets > LEAST_BUCKETS else 1)
    packed = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).where("id IS NOT NULL")
    packed = packed.mapInArrow(_pack_routes(k, per_cent, buckets, common), schema(bucket="int", low="long", width="int", payload="binary", links="binary"))
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, schema(a="long", b="long"))


def _stream_cells(k: int, per_cent: int):
    """Joins the cells of a partition sorted by (cell, block, id); holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, known, side = None, [], [], [], []

        def flush() -> list[tuple[int, int]]:
            return join_cell(ids, sets, per_cent, known if known and known[0] is not None else None, side if side and side[0] is not None else None) if len(ids) > 1 else []

        for batch in batches:
            links = []
            cells, blocks, rows, comps, sides = (batch.column(i).to_pylist() for i in range(5))
            for i, u in enumerate(_vec.shingle_sets(batch.column(5), k)):
                if now != (cells[i], blocks[i]):
                    links += flush()
                    now, ids, sets, known, side = (cells[i], blocks[i]), [], [], [], []
                ids.append(rows[i])
                sets.append(u)
                known.append(comps[i])
                side.append(sides[i])
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])
        links = flush()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return run


#: Bits of the filter that keeps texts which aren't wanted from being shuffled; its size is fixed, beyond it more of them pass.
FILTER_BITS = 1 << 25


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (id, ...) with the texts of their ids."""
    return rows.join(sifted(rows, texts), "id")


def sifted(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """texts (id, text) of the ids in rows and of few others: a bitmap of hashed ids, of a fixed size, is broadcast and drops the rest before any shuffle."""

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c, F.lit(7)), F.lit(FILTER_BITS)) + 1

    bits = rows.select(place("id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    bit = F.bitmap_bit_position("p")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    wanted = F.floor(byte / F.pow(F.lit(2.0), bit % 8)) % 2 == 1
    return texts.withColumn("p", place("id")).withColumn("bucket", F.bitmap_bucket_number("p")).join(F.broadcast(bits), "bucket").where(wanted).select("id", "text")


def _pack_shingles(k: int, buckets: int):
    """Documents to rows (bucket, ids, counts, shingles): 32 bits of each shingle of a bucket, document by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            u, own, ids_ = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held]), np.array(ids, np.int64)
            b = ((u >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            u, own, b = u[order].astype("<u4"), own[order], b[order]
            cut = np.searchsorted(b, np.arange(buckets + 1))
            rows = []
            for i in np.flatnonzero(np.diff(cut)).tolist():
                at, counts = np.unique(own[cut[i] : cut[i + 1]], return_counts=True)
                rows.append((i, ids_[at].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), u[cut[i] : cut[i + 1]].tobytes()))
            for a in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64]), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "ids", "counts", "shingles"])

        for batch in batches:
            for doc_id, u in zip(batch.column(0).to_pylist(), _vec.shingle_sets(batch.column(1), k)):
                if len(u):
                    held.append(u)
                    ids.append(doc_id)
                    size += len(u)
                if size >= HELD:
                    yield from send()
                    held, ids, size = [], [], 0
        if held:
            yield from send()
        held, ids = [], []
        _vec.trim()

    return run


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by bucket to (id, shared): shingles of the bucket that a document has in common with another; holds one bucket."""
    now, ids, shingles_ = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if now is None:
            return
        _, at, times = np.unique(np.concatenate(shingles_), return_inverse=True, return_counts=True)
        docs, own = np.unique(np.concatenate(ids), return_inverse=True)
        shared = np.bincount(own, weights=times[at] > 1, minlength=len(docs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(docs[shared > 0]), pa.array(shared[shared > 0])], ["id", "shared"])

    for batch in batches:
        for bucket, of, counts, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket != now:
                yield from done()
                now, ids, shingles_ = bucket, [], []
            ids.append(np.repeat(np.frombuffer(of, "<i8"), np.frombuffer(counts, "<u4")))
            shingles_.append(np.frombuffer(payload, "<u4"))
    yield from done()
    ids, shingles_ = [], []
    _vec.trim()


def linkable(rows: DataFrame, texts: DataFrame, k: int, per_cent: int, shingles_: int) -> DataFrame:
    """Those of rows (id, least, ...) that can be linked with another: least, the size of the id's smallest set, times per_cent / 100 of its shingles
    must be in other texts of rows. Shingles that fall together by their hashes, or rows that the bitmap lets through, only let more pass."""
    buckets = min(shingles_ // HELD + 1, 1 << 24)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)
    packed = sifted(rows, texts).mapInArrow(_pack_shingles(k, buckets), schema(bucket="int", ids="binary", counts="binary", shingles="binary"))
    shared = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_count_shared, schema(id="long", shared="long")).groupBy("id").agg(F.sum("shared").alias("shared"))
    return rows.join(shared, "id").where(F.col("shared") * 100 >= F.col("least") * per_cent).drop("shared")


#: Copies of a text that a round of block pairs has at most, roughly: they are on the disks at the same time.
ROUND_COPIES = 8


def _join_blocks(rows: DataFrame, k: int, per_cent: int) -> DataFrame:
    """rows: cell, block, id, comp, side, text."""
    dealt = rows.select("cell", "block", "id", "comp", "side", "text").repartition("cell", "block").sortWithinPartitions("cell", "block", "id")
    return dealt.mapInArrow(_stream_cells(k, per_cent), schema(a="long", b="long"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, per_cent: int = 80, block_rows: int = 512, block_shingles: int = 2_000_000, pivots: int = 16) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs; linked: 100 * intersection >= per_cent * union.

    component_id is the smallest id that links reach, the document's own included. A text of fewer
    than k words is one shingle; null texts and texts without words have no shingle, are linked
    with nothing and are components of their own. Rows with the same id are one document for the
    components (it has the links of all its texts), and each row is returned. A row without id links
    nothing; it gets the component of an equal set, or null. An empty table gives an empty table.
    Other columns are ignored, whatever their names. block_rows and block_shingles bound what a
    task holds at a time; a single text beyond them is held alone.
    """
    need(docs, (id_col, text_col), "ngram_jaccard_join")
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    signs = scratch.table(sketch(docs, id_col, text_col, k), "signs")

    folded = scratch.table(signs.where("n > 0 AND id IS NOT NULL").groupBy("digest", "n").agg(F.min("id").alias("rep")), "folded")
    total = signs.where("id IS NOT NULL").agg(F.sum("n")).first()[0] or 0
    common = common_shingles(docs, id_col, text_col, k, folded)
    met = connected_components(meetings(docs, id_col, text_col, k, per_cent, int(total), common), scratch, "cells")
    # An id that stands in several rows can represent several sets; it is one node.
    reps = folded.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"), F.min("n").alias("least"))
    cells = scratch.table(met.select(F.col("node").alias("id"), F.col("component").alias("cell")).join(reps, "id"), "cells")
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).where("id IS NOT NULL")

    def sizes(cells: DataFrame, name: str) -> tuple[DataFrame, DataFrame, tuple]:
        blocks = F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("weight") / block_shingles)).cast("long")
        stats = scratch.table(cells.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("n").alias("weight")).where("rows > 1").select("cell", "weight", blocks.alias("blocks")), f"stats{name}")
        giants = scratch.table(stats.where("blocks > 1"), f"giants{name}")
        return stats.select("cell", "blocks"), giants.select("cell", "blocks"), giants.agg(F.count("*"), F.sum("weight")).first()

    stats, giants, (n_giants, weight) = sizes(cells, "")
    if n_giants:
        # Passages that many texts share chain cells of documents that are linked with nothing: these go, and cells are measured again.
        marked = _by_cell(cells, giants, n_giants)
        thin = linkable(marked.where("blocks IS NOT NULL").select(*cells.columns), texts, k, per_cent, int(weight))
        cells = scratch.table(marked.where("blocks IS NULL").select(*cells.columns).unionByName(thin), "thin")
        stats, giants, (n_giants, _) = sizes(cells, "-thin")
        release(spark)
    # Cells without a row in giants have block_rows rows at most, so the join that drops those of one document has no hot key.
    marked = _by_cell(cells.select("id", "cell"), giants, n_giants)
    small = marked.where("blocks IS NULL").select("id", "cell").join(stats.where("blocks = 1").select("cell"), "cell", "left_semi").withColumn("blocks", F.lit(1).cast("long"))
    plan = scratch.table(marked.where("blocks IS NOT NULL").unionByName(small).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("id", "cell", "blocks", "block"), "plan")

    none = F.lit(None).cast("long")
    own = plan.select("cell", "block", "id", none.alias("comp"), none.alias("side"))
    if n_giants:
        # The pivots of a giant cell: its smallest hashes of ids, found by partial aggregates of bounded lists.
        low = plan.where("blocks > 1").groupBy("cell", "blocks", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(pivots)).alias("slot")).agg(F.min(F.struct(F.xxhash64("id", F.lit(2)), "id")).alias("p"))
        own = own.unionByName(low.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("p.id").alias("id"), none.alias("comp"), none.alias("side"))).distinct()
    links = scratch.table(_join_blocks(with_texts(own, texts), k, per_cent), "links")
    if n_giants:
        release(spark)
        links = _across_blocks(links, plan, texts, scratch, k, per_cent, n_giants)

    # Members of a set, and ids in several rows, are links too; both are one row for each document at most.
    twice = signs.where("n > 0 AND id IS NOT NULL").join(folded, ["digest", "n"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    repeated = folded.groupBy("rep").count().where("count > 1").limit(1).count() > 0 or signs.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).count() > 0
    if repeated:
        links = links.unionByName(twice)
    components = connected_components(links, scratch, "links")
    by_node = components.select(F.col("node").alias("rep"), "component")
    member = signs.select("id", "n", "digest").join(folded, ["digest", "n"], "left")
    if repeated:
        member = member.withColumn("rep", F.col("id"))
    out = member.join(by_node, "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def _by_cell(rows: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    return join_small(rows, cells.withColumnRenamed("cell", "__cell"), "cell", "__cell", n)


def _across_blocks(links: DataFrame, plan: DataFrame, texts: DataFrame, scratch: Scratch, k: int, per_cent: int, n_giants: int) -> DataFrame:
    """Links between blocks of a giant cell, where its documents aren't one component yet.

    The rows outside the cell's largest component are compared with all rows of the other blocks,
    pair of blocks by pair of blocks; each task holds two blocks. A text is copied for each pair of its block, so pairs
    are dealt into rounds, and the disks have the copies of one round only."""
    got = scratch.table(connected_components(links, scratch, "inner").select(F.col("node").alias("id"), "component"), "inner")
    rows = plan.where("blocks > 1").join(got, "id", "left").withColumn("comp", F.coalesce("component", "id")).select("cell", "block", "blocks", "id", "comp")
    counts = rows.groupBy("cell", "comp").agg(F.count("*").alias("n"))
    top = counts.groupBy("cell").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("cell", F.col("top.comp").alias("main"))
    rows = scratch.table(_by_cell(rows, top, n_giants).where("main IS NOT NULL").withColumn("rest", F.col("comp") != F.col("main")), "rest")
    if rows.limit(1).count() == 0:
        return links
    active = rows.where("rest").select("cell", "blocks", "block").distinct()
    # A block with rest rows meets every other block: the pair's lower block first.
    pairs = active.select("cell", "blocks", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("y")).where("x <> y")
    pairs = pairs.select("cell", "blocks", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct()
    rounds = -(-rows.agg(F.max("blocks")).first()[0] // ROUND_COPIES)
    sides = pairs.select("cell", F.explode(F.array(F.struct(F.col("i").alias("block"), F.lit(0).cast("long").alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).cast("long").alias("side")))).alias("s"), (F.col("i") * F.col("blocks") + F.col("j")).alias("pair"), F.pmod(F.col("i") + F.col("j"), F.lit(rounds)).alias("round"))
    tasks = scratch.table(sides.select("cell", "pair", F.col("s.block").alias("block"), F.col("s.side").alias("side"), "round"), "tasks")
    whole = scratch.table(with_texts(rows.select("cell", "block", "id", "comp"), texts), "rest-texts")
    for r in range(rounds):
        release(scratch.spark)
        now = F.broadcast(tasks.where(F.col("round") == r).drop("round"))
        dealt = whole.join(now, ["cell", "block"]).select("cell", F.col("pair").alias("block"), "id", "comp", "side", "text")
        links = links.unionByName(scratch.table(_join_blocks(dealt, k, per_cent), f"across-{r}"))
    scratch.drop("rest-texts")
    return links
