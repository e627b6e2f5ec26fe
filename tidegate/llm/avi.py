"""AVI motion-JPEG columns: RIFF with an index, intra frames, and shots as timed clip rows.

`store` writes bytes as grey 8-bit samples, 64 wide, in frames of up to 96 lines. Frames are lossless JPEG
(SOF3, predictor 1). Their Huffman table gives the category s of a difference 9-s bits, so code and
extra bits are nine bits together: a standard stream that numpy packs and unpacks at once.

`frames` follows the index of any AVI, or walks the chunks where there is none, and decodes frames of
that kind, and baseline ones (SOF0), whose luminance it returns.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import need, quoted, schema

WIDTH, LINES, PAD, RATE = 64, 96, 192, 25


class BadMedia(ValueError):
    """Bytes that aren't the media they should be."""


@functools.cache
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """(nine-bit code of each difference from -255, difference of each nine-bit code; 999 for the unused code)."""
    to, back = np.zeros(511, np.uint16), np.full(512, 999, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = ((1 << (8 - s)) - 1) << (s + 1) | (d if d >= 0 else d + (1 << s) - 1)
        to[d + 255] = code
        back[code] = d
    return to, back


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLE = _segment(0xC4, bytes([0, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))


def encode_lossless(samples: np.ndarray) -> bytes:
    """A grey lossless JPEG; the number of samples is a multiple of 8."""
    height, width = samples.shape
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, 1:] = x[:, 1:] - x[:, :-1]
    diff[1:, 0] = x[1:, 0] - x[:-1, 0]
    diff[0, 0] = x[0, 0] - 128
    c = _codes()[0][diff.ravel() + 255].reshape(-1, 8)
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = (c[:, j - 1] << (8 - j) | c[:, j] >> (j + 1)) & 0xFF
    out[:, 8] = c[:, 7] & 0xFF
    frame = _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
    scan = _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    return b"\xff\xd8" + _TABLE + frame + scan + out.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _decode_lossless(data: bytes, height: int, width: int) -> np.ndarray:
    n = height * width
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
    if n % 8 or len(raw) != n // 8 * 9:
        raise BadMedia("a frame doesn't have its samples")
    b = raw.reshape(-1, 9).astype(np.uint16)
    c = np.empty((len(b), 8), np.uint16)
    for j in range(8):
        c[:, j] = (b[:, j] << (j + 1) | b[:, j + 1] >> (7 - j)) & 0x1FF
    diff = _codes()[1][c.ravel()].reshape(height, width).astype(np.int32)
    if (diff == 999).any():
        raise BadMedia("an unused code")
    diff[:, 0] = np.cumsum(diff[:, 0]) + 128
    return (np.cumsum(diff, axis=1) & 0xFF).astype(np.uint8)


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order, from the rule of the walk along the diagonals."""
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    return np.array(order)


def _cosines() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None]
    m = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


def _huffman(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    code, at, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.n = len(data) * 8 + 64
        self.bits = int.from_bytes(data + b"\xff" * 8, "big")
        self.at = 0

    def take(self, k: int) -> int:
        self.at += k
        return self.bits >> (self.n - self.at) & ((1 << k) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise BadMedia("no such code")


def _decode_baseline(data: bytes, height: int, width: int, parts: list[tuple[int, int, int, int]], scan: dict[int, tuple[int, int]], quant: dict[int, np.ndarray], tables: dict[tuple[int, int], dict], restart: int) -> np.ndarray:
    """Luminance of a baseline frame; parts: (component, across, down, quantisation table)."""
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    zigzag, cosines = _zigzag(), _cosines()
    plane = np.zeros((down * parts[0][2] * 8, across * parts[0][1] * 8))
    runs, start, i = [], 0, 0
    while (i := data.find(b"\xff", i)) >= 0:  # restart markers part the stream
        if i + 1 < len(data) and 0xD0 <= data[i + 1] <= 0xD7:
            runs.append(data[start:i])
            start = i = i + 2
        else:
            i += 2
    runs.append(data[start:])
    streams = iter([_Bits(r.replace(b"\xff\x00", b"\xff")) for r in runs])
    bits, last = next(streams), dict.fromkeys((p[0] for p in parts), 0)
    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            bits, last = next(streams), dict.fromkeys(last, 0)
        for k, (c, h, v, q) in enumerate(parts):
            for by in range(v):
                for bx in range(h):
                    block = np.zeros(64)
                    s = bits.symbol(tables[0, scan[c][0]])
                    d = bits.take(s) if s else 0
                    last[c] += d if not s or d >> (s - 1) else d - (1 << s) + 1
                    block[0], at = last[c], 1
                    while at < 64:
                        rs = bits.symbol(tables[1, scan[c][1]])
                        run, s = rs >> 4, rs & 15
                        if not s:
                            if run != 15:
                                break
                            at += 16
                            continue
                        at += run
                        d = bits.take(s)
                        if at > 63:
                            raise BadMedia("a block has too many coefficients")
                        block[zigzag[at]] = d if d >> (s - 1) else d - (1 << s) + 1
                        at += 1
                    if k == 0:
                        table = np.zeros(64)
                        table[zigzag] = quant[q]
                        y, x = (mcu // across * v + by) * 8, (mcu % across * h + bx) * 8
                        plane[y : y + 8, x : x + 8] = cosines.T @ (block * table).reshape(8, 8) @ cosines
    return np.clip(np.rint(plane[:height, :width] + 128), 0, 255).astype(np.uint8)


def decode_jpeg(data: bytes) -> np.ndarray:
    """Samples of a lossless grey frame as `encode_lossless` makes, or the luminance of a baseline frame."""
    if data[:2] != b"\xff\xd8":
        raise BadMedia("not a JPEG")
    at, quant, tables, frame, restart = 2, {}, {}, None, 0
    own_table = False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise BadMedia("no marker where one should be")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(float)
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            own_table = data[at - 2 - size : at] == _TABLE
            i = 0
            while i < len(body) and not own_table:
                n = sum(body[i + 1 : i + 17])
                tables[body[i] >> 4, body[i] & 15] = _huffman(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker in (0xC0, 0xC3):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = marker, height, width, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            end = data.rfind(b"\xff\xd9")
            if frame is None or end < at:
                raise BadMedia("a frame is cut off")
            if frame[0] == 0xC3:
                if not own_table or body[-3] != 1:
                    raise BadMedia("a lossless frame of another kind")
                return _decode_lossless(data[at:end], frame[1], frame[2])
            scan = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            return _decode_baseline(data[at:end], frame[1], frame[2], frame[3], scan, quant, tables, restart)
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise BadMedia("a kind of frame that isn't intra-coded baseline or lossless")
    raise BadMedia("no scan")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, rate: int = RATE) -> bytes:
    """An AVI of one video stream of JPEG frames, with an index."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    stream = b"LIST" + struct.pack("<I", 4 + 8 + len(head) + 8 + len(form)) + b"strl" + _chunk(b"strh", head) + _chunk(b"strf", form)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + stream)
    index, at, chunks = [], 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        chunks.append(_chunk(b"00dc", f))
        at += len(chunks[-1])
    body = b"AVI " + headers + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Video:
    width: int
    height: int
    seconds_per_frame: float
    frames: list[bytes]


def read_avi(data: bytes) -> Video:
    """The first video stream, its frames by the index, or in file order where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("not an AVI")
    found: dict[bytes, tuple[int, int]] = {}
    strf = strh = None

    def walk(at: int, end: int) -> None:
        nonlocal strf, strh
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if at + 8 + size > len(data):
                raise BadMedia("a chunk is cut off")
            if kind == b"LIST":
                sort = data[at + 8 : at + 12]
                if sort == b"movi":
                    found[b"movi"] = (at + 8, at + 8 + size)
                elif sort in (b"hdrl", b"strl"):
                    walk(at + 12, at + 8 + size)
            elif kind == b"strh" and strh is None and data[at + 8 : at + 12] == b"vids":
                strh = struct.unpack_from("<4s4sIHHIII", data, at + 8)
            elif kind == b"strf" and strh is not None and strf is None:
                strf = struct.unpack_from("<Iii", data, at + 8)
            elif kind in (b"avih", b"idx1"):
                found[kind] = (at + 8, size)
            at += 8 + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if b"movi" not in found or strf is None:
        raise BadMedia("no video stream")
    base, end = found[b"movi"]
    places = []
    if b"idx1" in found:
        at, size = found[b"idx1"]
        for i in range(at, at + size - 15, 16):
            kind, _, offset, length = struct.unpack_from("<4sIII", data, i)
            if kind[2:] in (b"dc", b"db"):
                places.append((offset, length, kind))
        # offsets count from the list's type, or in some files from the file's start
        if places and data[base + places[0][0] : base + places[0][0] + 4] != places[0][2]:
            base = 0
        places = [(base + o + 8, n) for o, n, _ in places]
    else:
        at = base + 4
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST":
                at += 12
                continue
            if kind[2:] in (b"dc", b"db"):
                places.append((at + 8, size))
            at += 8 + size + size % 2
    if any(a + n > len(data) for a, n in places):
        raise BadMedia("the index points beyond the file")
    scale, rate = strh[6], strh[7]
    return Video(abs(strf[1]), abs(strf[2]), scale / rate if rate else struct.unpack_from("<I", data, found[b"avih"][0])[0] / 1e6, [data[a : a + n] for a, n in places])


def shots(histograms: np.ndarray, window: int = 8, ratio: float = 2.5, least: float = 0.25) -> list[int]:
    """First frames of shots. A frame starts one if half the L1 distance of its histogram (shares, so 0 to 1) from the
    frame before is at least `least` and `ratio` times the mean of the last `window` distances inside the shot."""
    if not len(histograms):
        return []
    out, recent = [0], []
    jumps = np.abs(np.diff(histograms, axis=0)).sum(1) / 2
    for i, jump in enumerate(jumps.tolist(), 1):
        if jump >= least and (not recent or jump >= ratio * (sum(recent) / len(recent))):
            out.append(i)
            recent = []
        else:
            recent = [*recent, jump][-window:]
    return out


def histogram(samples: np.ndarray, bins: int = 32) -> np.ndarray:
    return np.bincount(samples.ravel() >> (8 - bins.bit_length() + 1), minlength=bins) / max(1, samples.size)


def store(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 192 of them, as an AVI."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return write_avi([encode_lossless(lines[a : a + LINES]) for a in range(0, len(lines), LINES)], WIDTH, LINES)


CLIPS = schema(clip="int", first_frame="int", n_frames="int", start_s="double", end_s="double")


def clip_rows(video: Video, decoded: list[np.ndarray]) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frames, start and end in seconds)."""
    cuts = shots(np.array([histogram(f) for f in decoded])) if decoded else []
    ends = [*cuts[1:], len(decoded)]
    return [(k, a, b - a, a * video.seconds_per_frame, b * video.seconds_per_frame) for k, (a, b) in enumerate(zip(cuts, ends))]


def clips(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, clip, first_frame, n_frames, start_s, end_s, error) of each AVI in a binary column.

    A null or a video without frames has one row with clip null; so have bytes that can't be read, with what is wrong in error.
    Rows with one id give their clips each; an empty table gives an empty table."""
    need(media, (id_col, media_col), "clips")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    video = read_avi(data.as_py()) if data.is_valid else Video(0, 0, 0.0, [])
                    got = [(*c, None) for c in clip_rows(video, [decode_jpeg(f) for f in video.frames])]
                except (BadMedia, struct.error, IndexError, KeyError, StopIteration, ValueError) as e:
                    got = [(None,) * 5 + (str(e),)]
                rows += [(i, *c) for c in got or [(None,) * 6]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()))], [id_col, *CLIPS.names, "error"])

    out = schema(**{id_col: "long"}, clip="int", first_frame="int", n_frames="int", start_s="double", end_s="double", error="string")
    return media.select(quoted(id_col).cast("long").alias(id_col), quoted(media_col).cast("binary").alias("m")).mapInArrow(run, out)


STORED = schema(id="long", n_bytes="long", payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string", feature="string")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text as an AVI and what reading that back gives: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media]).

    The payload is the text in UTF-8 with spaces up to a positive multiple of 192; null is empty. The feature has the
    number of frames, the first frames of clips with their seconds, and the mean sample. Equal texts give equal values. Media are made one
    document at a time. Other columns are ignored; an empty table gives an empty table."""
    need(docs, (id_col, text_col), "store_texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py() or ""
                data = data.encode("utf-8", "surrogatepass")
                media = store(data + b" " * (-len(data) % PAD or (0 if data else PAD)))
                video = read_avi(media)
                decoded = [decode_jpeg(f) for f in video.frames]
                payload = b"".join(f.tobytes() for f in decoded)
                found = clip_rows(video, decoded)
                mean = sum(int(f.sum(dtype=np.int64)) for f in decoded) / len(payload)
                feature = f"frames={len(decoded)};clips={len(found)};at={','.join(f'{a}@{s:.2f}-{e:.2f}' for _, a, _, s, e in found)};mean={mean:.4f}"
                row = (i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                rows.append((*row, media) if with_media else row)
                if with_media and sum(r[5] for r in rows) > 1 << 24:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 9 if with_media else 8]
    names = [*STORED.names, "media"][: len(kinds)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    out = schema(**{f.name: {"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in STORED.fields}, **({"media": "binary"} if with_media else {}))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
