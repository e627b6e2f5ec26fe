"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are code points; letters are lower-cased, everything else counts as a space. n-grams of
each order are hashed into buckets. Fitting sums the bucket counts of each language where the
rows are and brings at most languages x buckets sums to the driver; the matrix of log-probabilities
has that size too, and is broadcast. Scoring gathers the matrix rows of a batch's n-grams and
differences their running sum at the texts' ends, so no Python loop runs over characters or texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _vec
from ._base import need, quoted, schema, without

UNDETERMINED = "und"
TEXT_BYTES = 1 << 18
#: Cells of the matrix of n-grams x languages that is summed at a time.
CELLS = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray  # of each language
    log_prob: np.ndarray  # bucket x language
    orders: tuple[int, ...]
    bits: int


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case letter of each code point; a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of UTF-8 texts, and the texts' offsets in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return _letters()[points], heads[offsets]


def buckets(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point; those near the end are cut off."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.full(n, np.uint64(order * 2 + 1))
    for i in range(order):
        key = key * np.uint64(0x9FB21C651E98DF25) + points[i : n + i].astype(np.uint64)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def windows(data: np.ndarray, offsets: np.ndarray, overlap: int, most: int = TEXT_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """(bytes, offsets, own) of a slice, at once (own None), or of one long text in parts: the n-grams of a part are those that start at its first
    `own` code points; it reaches `overlap` code points into the next one, so that each n-gram is in one part."""
    if len(offsets) > 2 or len(data) <= 2 * most:
        yield data, offsets, None
        return
    heads = (data & 0xC0) != 0x80
    a = 0
    while a < len(data):
        ahead = np.flatnonzero(heads[a + most : a + most + 4])
        b = a + most + int(ahead[0]) if len(ahead) else len(data)
        more = np.flatnonzero(heads[b : b + 4 * overlap + 4])
        end = b + int(more[overlap]) if len(more) > overlap else len(data)
        yield data[a:end], np.array([0, end - a]), int(heads[a:b].sum())
        a = b


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, max_rows: int = 50_000, alpha: float = 0.5) -> Model:
    """Learn from the rows that have a text and a language; of more than max_rows of them, from those
    with the smallest hashes of their ids (about max_rows; a documented bound, the only sample here).
    No such row: a model without languages, which finds every text undetermined."""
    need(docs, (text_col, lang_col, id_col), "language_id.fit")
    rows = docs.select(quoted(text_col).alias("text"), quoted(lang_col).alias("lang"), F.xxhash64(quoted(id_col)).alias("h")).where("text IS NOT NULL AND lang IS NOT NULL")
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.col("h") <= int(-(2**63) + 2**64 * (max_rows / total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, data, offsets in _vec.slices(batch.column(0), TEXT_BYTES):
                for lang in langs[first : first + len(offsets) - 1]:
                    texts[lang] = texts.get(lang, 0) + 1
                for some, place_, own in windows(data, offsets, max(orders) - 1):
                    points, at = code_points(some, place_)
                    for order in orders:
                        got = buckets(points, order, bits)
                        for i in range(len(place_) - 1):
                            counted = sums.setdefault(langs[first + i], np.zeros(1 << bits, np.int64))
                            part = got[at[i] : max(at[i], at[i + 1] - order + 1)][:own]
                            if len(part) > 1 << bits:
                                counted += np.bincount(part, minlength=1 << bits)
                            else:
                                np.add.at(counted, part, 1)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(s[at], texts[lang]))], ["lang", "bucket", "n"])

    sums = rows.select("text", "lang").mapInArrow(run, schema(lang="string", bucket="long", n="long")).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(set(sums["lang"].to_pylist())))
    counts, prior = np.zeros((1 << bits, len(languages))), np.zeros(len(languages))
    place = {x: i for i, x in enumerate(languages)}
    col = np.array([place[x] for x in sums["lang"].to_pylist()], np.int64)
    bucket, n = sums["bucket"].to_numpy().astype(np.int64), sums["n"].to_numpy()
    if languages:
        counts[bucket[bucket >= 0], col[bucket >= 0]] = n[bucket >= 0]
        prior[col[bucket < 0]] = n[bucket < 0]
        counts += alpha
        counts = np.log(counts / counts.sum(0))
        prior = np.log(prior / prior.sum())
    return Model(languages, prior, counts.astype(np.float32), tuple(orders), bits)


def score(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the likeliest language or -1, its posterior) of each text of a slice. A long text is summed part by part, so memory doesn't grow with it."""
    n = len(offsets) - 1
    total, known = np.tile(model.log_prior, (n, 1)), np.zeros(n, bool)
    for some, place, own in windows(data, offsets, max(model.orders, default=1) - 1):
        points, at = code_points(some, place)
        letters = np.concatenate(([0], np.cumsum(points != 32)))
        known |= letters[at[1:]] > letters[at[:-1]]
        if not model.languages:
            continue
        for order in model.orders:
            got = buckets(points, order, model.bits)[:own]
            first = np.minimum(at[:-1], len(got))
            last = np.clip(at[1:] - order + 1, first, len(got))
            step = max(1, CELLS // len(model.languages))
            for a in range(0, len(got), step):
                part = got[a : a + step]
                run = np.zeros((len(part) + 1, len(model.languages)))
                np.cumsum(model.log_prob[part], axis=0, dtype=np.float64, out=run[1:])
                i, j = np.searchsorted(last, a, "right"), np.searchsorted(first, a + len(part), "left")
                total[i:j] += run[np.clip(last[i:j] - a, 0, len(part))] - run[np.clip(first[i:j] - a, 0, len(part))]
    if not model.languages:
        return np.full(n, -1), np.zeros(n)
    best = total.argmax(1)
    posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return np.where(known, best, -1), np.where(known, posterior, 0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs and lang_pred, score; input columns of these names give way.

    `und` with score 0 for null texts, texts without a letter and models without languages.
    Equal texts get equal results up to the last digits of the score, repeated rows too, each its own; the likeliest language of a tie is the
    first by code point. Very long texts are read whole, in parts of TEXT_BYTES. An empty table gives an empty table. Columns pass
    as they are, a null or odd id too.
    """
    need(docs, (text_col,), "language_id.predict")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = without(docs, ("lang_pred", "score", "__text"))
    rows = docs.select(*keep, quoted(text_col).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            langs, scores = [], []
            for _, data, offsets in _vec.slices(batch.column(batch.num_columns - 1), TEXT_BYTES):
                best, posterior = score(model, data, offsets)
                langs.append(names[best])
                scores.append(posterior)
            new = [pa.array(np.concatenate(langs) if langs else [], pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, out)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary")) % 5
