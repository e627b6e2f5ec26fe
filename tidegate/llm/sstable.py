"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their keys. Keys are the eight bytes of the id, highest
first, with the sign turned, so bytes sort as ids do. Data blocks store each key as the number of bytes
shared with the key before it and the rest, and the ids as 16- or 32-bit integers; a block is
compressed if that helps. A sparse index has the first key and place of each block, a Bloom filter the
keys; a footer of fixed size points to both. A lookup reads footer, filter, index and one block.

    shard  = block* index filter footer
    block  = kind (0 raw, 1 zstd) bytes of: (shared varint, rest varint, value varint, rest, value)*
    index  = (first key 8, offset 8, length 8, tokens before the block 8)*
    filter = hash count 4, bits 4, bytes
    footer = offsets and lengths of index and filter, documents, tokens, width of ids, magic
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _blobs, _vec
from ._base import Scratch, need, quoted, schema

MAGIC = b"TGSST\x00\x01\n"
FOOTER = struct.Struct("<QQQQQQQ8s")
ENTRY = struct.Struct(">QQQQ")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
BITS_PER_KEY, HASHES = 10, 7
TEXT_BYTES = 1 << 20


def key_of(doc_id: int | None) -> bytes:
    """Null sorts first, as an empty key."""
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of keys (as unsigned integers) in the filter, by double hashing."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


class ShardWriter:
    def __init__(self, stream, wide: bool):
        self.stream, self.wide = stream, wide
        self.block, self.first, self.last = bytearray(), None, b""
        self.index, self.keys, self.at, self.docs, self.tokens, self.before = [], [], 0, 0, 0, 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes, n_tokens: int) -> None:
        if self.first is None:
            self.first, self.last, self.before = key, b"", self.tokens
        shared = next((i for i, (x, y) in enumerate(zip(self.last, key)) if x != y), min(len(self.last), len(key)))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(int.from_bytes(key, "big"))
        self.docs += 1
        self.tokens += n_tokens
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.first is None:
            return
        raw = bytes(self.block)
        packed = self.packer.compress(raw)
        data = b"\x01" + packed if len(packed) < len(raw) else b"\x00" + raw
        self.stream.write(data)
        self.index.append((int.from_bytes(self.first, "big"), self.at, len(data), self.before))
        self.at += len(data)
        self.block, self.first = bytearray(), None

    def close(self) -> None:
        self.flush()
        index = b"".join(ENTRY.pack(*e) for e in self.index)
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        flags = np.zeros(bits, np.uint8)
        if self.keys:
            flags[bloom_places(np.array(self.keys, np.uint64), bits).ravel()] = 1
        bloom = struct.pack("<II", HASHES, bits) + np.packbits(flags).tobytes()
        self.stream.write(index + bloom)
        self.stream.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.tokens, 4 if self.wide else 2, MAGIC))
        self.stream.close()


class ShardReader:
    """Over a seekable file."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.docs, self.tokens, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(index_at)
        data = file.read(index_len)
        self.index = [ENTRY.unpack_from(data, i) for i in range(0, index_len, ENTRY.size)]
        file.seek(bloom_at)
        bloom = file.read(bloom_len)
        self.bits = struct.unpack_from("<II", bloom)[1]
        self.flags = np.unpackbits(np.frombuffer(bloom, np.uint8, offset=8))
        self.dtype = np.dtype("<u4" if self.width == 4 else "<u2")

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, length, _ = self.index[i]
        self.file.seek(at)
        data = self.file.read(length)
        data = zstandard.ZstdDecompressor().decompress(data[1:]) if data[0] else data[1:]
        at, key = 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, value in self.block(i):
                yield id_of(key), np.frombuffer(value, self.dtype)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of the documents with this key: none, or one for each row that had it."""
        key = key_of(doc_id)
        number = int.from_bytes(key, "big")
        if not self.docs or not self.flags[bloom_places(np.array([number], np.uint64), self.bits)].all():
            return []
        low, high = 0, len(self.index)
        while low < high:  # first block whose first key is at or beyond the key
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < number else (low, mid)
        out = []
        for i in range(max(0, low - 1), len(self.index)):
            if self.index[i][0] > number:
                break
            out += [np.frombuffer(v, self.dtype) for k, v in self.block(i) if k == key]
        return out


#: Bytes that white space can have; an added token without them never arises where parts are put together.
_PARTING = re.compile(rb"[\x00-\x20\x7f\x80-\xff]")

#: Classes of bytes. SOLID ones can't begin or be white space of any kind; bytes that may begin a white space character beyond ASCII count as neither.
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = _ASCII & ~_LETTER
_PUNCT[48:58] = False
_SOLID = _ASCII.copy()
_SOLID[0x80:] = True
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of parts of the texts that the byte-level pattern never joins, whatever stands around them.

    Its pieces look at no character before them. A part starts at a space before a solid byte; at punctuation behind a letter; at a
    line end behind a solid character; and behind such a line end, if it is alone."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        solid, ascii_, newline = _SOLID[data], _ASCII[data], data == 0x0A
        cut[: n - 1] = (data[:-1] == 0x20) & solid[1:]
        cut[offsets[1:] - 1] = False  # what follows is another text
        cut[1:n] |= _LETTER[data[:-1]] & _PUNCT[data[1:]] | newline[1:] & ascii_[:-1]
        cut[2:n] |= newline[1:-1] & ascii_[:-2] & solid[2:]
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece of the texts once.

    Pieces are found and hashed (64 bits) for a batch at a time in numpy, and their ids gathered from a pool; only unseen pieces go
    to the library, many in one string, parted so that they stay pieces. The pool holds a bounded number of pieces and
    starts anew beyond. Two pieces of a pool with one hash would get the ids of the one seen first; with at most a million pieces in a
    pool an unseen one has a chance of 5e-14 of that. A text that holds the string of an added token goes to the library whole, and so do all
    texts for tokenizers that aren't byte-level with the usual pattern or have added tokens with white space in them."""

    MOST, SLOTS = 1_000_000, 1 << 21

    def __init__(self, path: str, wide: bool | None = None):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 if wide is None else wide
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or [] if t["content"]]
        self.by_parts = not any(_PARTING.search(t) for t in self.added) and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.reset()

    def reset(self) -> None:
        self.keys, self.place = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.starts, self.counts, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.pool, self.filled = np.zeros(1 << 18, self.dtype), 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.place[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], (slot[go] + 1) & (self.SLOTS - 1)
        return out

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        """New, distinct hashes."""
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.place[slot[take]] = h[take], entry[take]
            rest = np.ones(len(h), bool)
            rest[take] = False
            h, entry, slot = h[rest], entry[rest], (slot[rest] + 1) & (self.SLOTS - 1)

    def _learn(self, h: np.ndarray, parts: list[bytes]) -> None:
        """Ids of unseen parts. Parts of solid bytes, with or without a space before, share a string: such a space starts a piece
        behind anything, and so does a line end between solid characters; others are encoded alone."""
        ids: list[list[int] | np.ndarray] = [[]] * len(parts)
        solid = [i for i, p in enumerate(parts) if len(p) > (p[0] == 0x20) and _SOLID[np.frombuffer(p, np.uint8)[int(p[0] == 0x20) :]].all()]
        chosen = set(solid)
        alone = [i for i in range(len(parts)) if i not in chosen]
        for i, got in zip(alone, self.whole([parts[i].decode("utf-8", "replace") for i in alone])):
            ids[i] = got
        line = self.whole(["\n"])[0]
        for a in range(0, len(solid), 8192):
            group, texts, spare = solid[a : a + 8192], [], []
            for i in group:
                t = parts[i].decode("utf-8", "replace")
                spare.append(0 if t[0] == " " or not texts else len(line))
                texts.append(t if t[0] == " " or len(texts) == 0 else "\n" + t)
            got = self.tokenizer.encode("".join(texts), add_special_tokens=False)
            firsts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            cuts = np.searchsorted(np.fromiter((o[0] for o in got.offsets), np.int64, len(got.offsets)), firsts, "left")
            all_ = np.array(got.ids, self.dtype)
            for k, i in enumerate(group):
                ids[i] = all_[cuts[k] + spare[k] : cuts[k + 1]]
        counts = np.array([len(x) for x in ids], np.int32)
        total, n = int(counts.sum()), len(parts)
        while self.n + n > len(self.starts):
            self.starts, self.counts = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.counts))
        while self.filled + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        if total:
            self.pool[self.filled : self.filled + total] = np.concatenate([np.asarray(x, self.dtype) for x in ids])
        self.starts[self.n : self.n + n] = self.filled + np.cumsum(counts) - counts
        self.counts[self.n : self.n + n] = counts
        self._insert(h, np.arange(self.n, self.n + n))
        self.n, self.filled = self.n + n, self.filled + total

    def _with_added(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Whether each text holds the string of an added token."""
        out = np.zeros(len(offsets) - 1, bool)
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(token) <= offsets[row + 1]
                out[row] |= inside
                at = raw.find(token, int(offsets[row + 1]) if inside else at + 1)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start, with the total at the end) of UTF-8 texts."""
        texts, raw = len(offsets) - 1, data.tobytes()
        alone = self._with_added(raw, offsets) if self.by_parts else np.ones(texts, bool)
        if not alone.any():
            return self._encode_parts(data, offsets, raw)
        ids, counts = [], []
        for run in np.split(np.arange(texts), np.flatnonzero(np.diff(alone)) + 1):  # runs of texts of one kind
            a, b = int(run[0]), int(run[-1]) + 1
            if alone[a]:
                got = self.whole([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in range(a, b)])
                ids.append(np.array([x for g in got for x in g], self.dtype))
                counts += [len(g) for g in got]
            else:
                some, at = self._encode_parts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]])
                ids.append(some)
                counts += np.diff(at).tolist()
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))

    def _encode_parts(self, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """encode() for texts without added tokens."""
        texts = len(offsets) - 1
        starts = pieces(data, offsets[: texts + 1]) if len(data) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        h = np.maximum(_vec.hashes(data, starts, ends, _vec.VALUES), np.uint64(1))
        entry = self._find(h)
        if (entry < 0).any():
            if self.n > self.MOST:
                self.reset()
                entry[:] = -1
            new, first = np.unique(h[entry < 0], return_index=True)
            at = np.flatnonzero(entry < 0)[first]
            self._learn(new, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            entry = self._find(h)
        counts = self.counts[entry].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(counts)))
        ids = self.pool[np.repeat(self.starts[entry] - before[:-1], counts) + np.arange(int(before[-1]))]
        return ids, before[np.searchsorted(starts, offsets)]


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder; its pool serves the worker's next tasks too."""
    return Encoder(path)


def _write(root: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, files, done = _encoder(tokenizer), _blobs.Writer(root, ".sst"), []
        end, writer, name = np.array([end_id], encoder.dtype).tobytes(), None, None

        def close() -> None:
            nonlocal writer
            if writer is not None:
                writer.close()
                done.append((TaskContext.get().partitionId(), len(done), name, writer.docs, writer.tokens))
            writer = None

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, offsets in _vec.slices(batch.column(1), TEXT_BYTES):
                tokens, at = encoder.encode(data, offsets)
                for i in range(len(offsets) - 1):
                    if writer is None:
                        name, stream = files.create()
                        writer = ShardWriter(stream, encoder.wide)
                    writer.add(key_of(ids[first + i]), tokens[at[i] : at[i + 1]].tobytes() + end, int(at[i + 1] - at[i]) + 1)
                    if writer.at >= SHARD_BYTES:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "file", "docs", "tokens"])

    return run


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> tuple[DataFrame, str]:
    """(manifest, folder): shards of all documents in ascending order of id, dealt by range.

    The manifest has (part, seq, file, docs, tokens, start): start is the number of ids of all shards before. Null texts are empty, a null id comes
    first, rows with one id follow each other by their text. An empty table makes no shard. Other columns are ignored."""
    need(docs, (id_col, text_col), "write_shards")
    scratch = Scratch(docs.sparkSession, "sstable")
    root = scratch.at("files")
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"), "text")
    manifest = scratch.table(dealt.mapInArrow(_write(root, tokenizer, end_id), schema(part="long", seq="long", file="string", docs="long", tokens="long")), "manifest")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(order), F.lit(0)).cast("long")), root


def read_shards(manifest: DataFrame, root: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the shards; the crc is of its ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with _blobs.open_file(root, name) as file:
                    for doc_id, ids in ShardReader(file):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 10_000])], ["id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    spread = manifest.select("file", "start").repartition(n, "file")
    return spread.mapInArrow(run, schema(id="long", start="long", n_tokens="long", ids_crc32="long"))
