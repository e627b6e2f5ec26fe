"""WARC conversion, token shards, AVI columns and page differencing: round trips and brute force."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from html import unescape

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegate.llm import avi, html_text, sstable, warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, text string, n_chars int, key string, file int"
DOCS = "doc_id bigint, text string, id string, n_bytes int, media string, start int"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "é Ω \U0001f600", "word " * 700, "tab\tand\n\nlines  two   three \n end ", " 　x \xa0 y", "x" * 5000, "don't we'll 12 345, it's <|endoftext|> a\x00b", "Ein Wort.\nZwei Wörter,  drei", "a \nb", "a\n b", "\n  b", " a  b", "a " * 3 + " ", "naïve   text\x85next", "a \x1cb \x1f c"]


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", 1, "k", 2) for i, u, h in rows], PAGES)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "m", 5) for i, t in rows], DOCS)


# --- archives ------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [warc.ArcRecord("http://a.example/x", "10.0.0.1", "20200102030405", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>hi\n\n</p>"), warc.ArcRecord("dns:a.example", "10.0.0.2", "202001020304", "text/dns", b"a. 10.0.0.1"), warc.ArcRecord("http://a.example/e", "0.0.0.0", "2020", "text/html", b"")]
    data = warc.arc_version_block(version, "x.arc", "20200101000000") + b"".join(warc.arc_record(version, r) for r in records)
    for form in (data, gzip.compress(data)):
        got = list(warc.parse_arc(form))
        assert got[0].url == "filedesc://x.arc" and got[1:] == records
    out = list(warc.parse_warc(b"".join(gzip.compress(warc.to_warc(r)) for r in warc.parse_arc(data))))
    assert [h["warc-type"] for h, _ in out] == ["warcinfo", "response", "resource", "resource"]
    head, block = out[1]
    assert block == records[0].body and head["warc-date"] == "2020-01-02T03:04:05Z" and head["warc-ip-address"] == "10.0.0.1"
    assert head["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>hi\n\n</p>").digest()).decode()
    assert [h["warc-date"] for h, _ in out[2:]] == ["2020-01-02T03:04:00Z", "2020-01-01T00:00:00Z"]
    assert len({h["warc-record-id"] for h, _ in out}) == 4 and warc.to_warc(records[0]) == warc.to_warc(records[0])


def test_bad_archives_are_told():
    good = warc.arc_version_block(1, "x", "20200101000000")
    for bad in (b"", b"no", good + b"http://a 1.1.1.1 2020 text/html 99\nshort", good + b"http://a text/html x\n", good.replace(b"\n1 0", b"\n7 0")):
        with pytest.raises(warc.BadArchive):
            list(warc.parse_arc(bad))
    record = warc.to_warc(warc.ArcRecord("http://a", "1.1.1.1", "2020", "text/html", b"HTTP/1.0 200 OK\r\n\r\nx"))
    with pytest.raises(warc.BadArchive):
        list(warc.parse_warc(record.replace(b"\r\n\r\nx", b"\r\n\r\ny")))


def test_pages_through_the_archive(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (9, "http://a/9 b", "same"), (9, "u", "other"), (3, "", None), (4, "x", ""), (5, "x", "lonely é"), (6, "x", "y" * 3_000_000), (None, "x", "same"), (None, "x", "none"), (None, "z", "none"), (7, "x", "HTTP/1.1\r\n\r\n")]
    got = warc.archive(pages_of(spark, rows), file_bytes=2000).collect()
    keep = {}
    for i, _, h in rows:
        if i is not None:
            keep[h or ""] = max(i, keep.get(h or "", i))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        k = keep.get(h or "")
        kind, refers = ("response", None) if i == k else ("revisit", k)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, refers))
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, want))
    assert len({r["file"] for r in got}) > 1
    assert warc.archive(pages_of(spark, [])).count() == 0
    assert {r["record_type"] for r in warc.archive(pages_of(spark, rows), min_bytes=10**7).collect()} == {"response"}


def test_pages_with_repeated_ids_and_urls_of_version_blocks(spark):
    def types(rows):
        return sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive(pages_of(spark, [(i, u, h) for i, u, h in rows])).collect())

    assert types([(1, "filedesc://x.arc", "one"), (2, "http://a/", "two!")]) == [(1, 3, "response", None), (2, 4, "response", None)]
    assert types([(5, "u", "A"), (7, "u", "BB"), (5, "u", "BB")]) == [(5, 1, "response", None), (5, 2, "revisit", 7), (7, 2, "response", None)]
    assert types([(5, "u", "A"), (5, "u", "BB"), (9, "u", "A"), (8, "u", "BB")]) == [(5, 1, "revisit", 9), (5, 2, "revisit", 8), (8, 2, "response", None), (9, 1, "response", None)]


# --- shards --------------------------------------------------------------------


def test_encoder_equals_the_library():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(1)
    alphabet = ["<|endoftext|>", "<|endoftext|", "|>", "a", "é", " ", "  ", "\n", "\t", "'", "s", "1", ".", "\xa0", "　", "漢", "\x1c", "B", " x", "\n\n", "\r\n", ",", " .", "¿", "\x00", "\x85"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for most in (10**6, 50):
        encoder = sstable.Encoder(TOKENIZER)
        assert encoder.by_parts
        encoder.MOST, got = most, []
        for a in range(0, len(texts), 100):
            raw = [t.encode() for t in texts[a : a + 100]]
            ids, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
            got += [ids[at[i] : at[i + 1]].tolist() for i in range(len(raw))]
        assert got == want
    encoder.by_parts = False
    ids, at = encoder.encode(np.frombuffer(b"a b", np.uint8), np.array([0, 0, 3]))
    assert (ids.tolist(), at.tolist()) == (want[texts.index("a")] + tokenizer.encode(" b").ids, [0, 0, 2])


def test_added_tokens_are_one_id_inside_a_text_only():
    encoder = sstable.Encoder(TOKENIZER)
    raw = [b"a<|endoftext|>b", b"a<|endof", b"text|>b", b"", b"<|endoftext|><|endoftext|>", b"plain words"]
    ids, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    got = [ids[at[i] : at[i + 1]].tolist() for i in range(len(raw))]
    assert got == [Tokenizer.from_file(TOKENIZER).encode(r.decode(), add_special_tokens=False).ids for r in raw]
    assert got[0] == [64, 50256, 65] and got[4] == [50256, 50256] and 50256 not in got[1] + got[2]


def test_tables_round_trip_and_lookup(monkeypatch):
    class Stream(io.BytesIO):
        def close(self):
            pass

    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    rng = random.Random(2)
    keys = sorted([None, None, -(2**63), -5, 0, 1, 1, 2**63 - 1, *(rng.randint(-1000, 10**12) for _ in range(300))], key=lambda k: (k is not None, k or 0))
    for wide in (False, True):
        out = Stream()
        writer, rows = sstable.ShardWriter(out, wide), []
        for k in keys:
            ids = np.array(rng.choices(range(60_000), k=rng.choice((0, 1, 5, 80))), "<u4" if wide else "<u2")
            rows.append((k, ids.tolist()))
            writer.add(sstable.key_of(k), ids.tobytes(), len(ids))
        writer.close()
        reader = sstable.ShardReader(io.BytesIO(out.getvalue()))
        assert [(k, v.tolist()) for k, v in reader] == rows and len(reader.index) > 5
        for k in {*keys, 3, 77, -6}:
            assert [v.tolist() for v in reader.lookup(k)] == [v for x, v in rows if x == k]
        assert sum(bool(reader.flags[sstable.bloom_places(np.array([x], np.uint64), reader.bits)].all()) for x in range(10**6, 10**6 + 2000)) < 100
        assert reader.tokens == sum(len(v) for _, v in rows) and reader.index[-1][3] <= reader.tokens
    with pytest.raises(ValueError):
        sstable.ShardReader(io.BytesIO(b"x" * 200))


def test_shards_of_documents(spark, monkeypatch):
    rows = [(i * 7 % 31, t) for i, t in enumerate(TEXTS)] + [(5, "again"), (5, "twice"), (None, "no id"), (-3, "below")]
    manifest, root = sstable.write_shards(docs_of(spark, rows), TOKENIZER)
    got = sorted(sstable.read_shards(manifest, root).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in got] == sorted((i for i, _ in rows), key=lambda k: (k is not None, k or 0))
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want, at = {}, 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == at
        want[r["id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]
    manifest, root = sstable.write_shards(docs_of(spark, []), TOKENIZER)
    assert sstable.read_shards(manifest, root).count() == 0


# --- media ---------------------------------------------------------------------


def test_texts_as_media(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, "z" * 192, "é" * 96 + "x", "".join(chr(i % 250 + 1) for i in range(30_000)), "a", "a"])]
    got = {r["doc_id"]: r for r in avi.store_texts(docs_of(spark, rows), with_media=True).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert b"".join(avi.decode_jpeg(f).tobytes() for f in avi.read_avi(bytes(r["media"])).frames) == payload
    assert got[len(rows) - 1]["feature"] == got[len(rows) - 2]["feature"]
    assert avi.store_texts(docs_of(spark, [])).count() == 0


def test_every_difference_survives():
    rng = np.random.default_rng(1)
    for shape in ((3, 64), (1, 8), (96, 64)):
        x = rng.integers(0, 256, shape, dtype=np.uint8)
        x.flat[::2] = rng.choice([0, 255], len(x.flat[::2]))
        assert (avi.decode_jpeg(avi.encode_lossless(x)) == x).all()


def baseline(image):
    """A plain grey baseline JPEG encoder: quantisation by one, fixed-length codes."""
    m = avi._cosines()
    zigzag, bits, last = avi._zigzag(), [], 0
    ac = [0x00, 0xF0, *[r << 4 | s for r in range(16) for s in range(1, 11)]]

    def put(v, n):
        bits.extend(v >> (n - 1 - i) & 1 for i in range(n))

    def extra(v):
        s = abs(v).bit_length()
        put(v if v >= 0 else v + (1 << s) - 1, s)

    h, w = image.shape
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            c = np.rint(m @ (image[y : y + 8, x : x + 8] - 128.0) @ m.T).astype(int).ravel()[zigzag].tolist()
            put(abs(c[0] - last).bit_length(), 4)
            extra(int(c[0] - last))
            last, run = c[0], 0
            end = max([i for i in range(64) if c[i]], default=0)
            for v in c[1 : end + 1]:
                if not v:
                    run += 1
                    if run == 16:
                        put(1, 8)
                        run = 0
                    continue
                put(ac.index(run << 4 | abs(int(v)).bit_length()), 8)
                extra(int(v))
                run = 0
            if end < 63:
                put(0, 8)
    bits += [1] * (-len(bits) % 8)
    body = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    seg = avi._segment
    return b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC4, bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)])) + seg(0xC4, bytes([0x10, *[0] * 7, len(ac), *[0] * 8, *ac])) + seg(0xC0, bytes([8, 0, h, 0, w, 1, 1, 0x11, 0])) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body + b"\xff\xd9"


def test_baseline_frames_shots_and_clips(spark):
    rng = np.random.default_rng(2)
    dark, bright = (np.clip(rng.normal(mean, 10, (16, 24)), 0, 255).astype(np.uint8) for mean in (60, 190))
    got = avi.decode_jpeg(baseline(dark))
    assert np.abs(got.astype(int) - dark).max() <= 3
    frames = [baseline(dark)] * 5 + [baseline(bright)] * 3 + [baseline(dark)] * 2
    video = avi.write_avi(frames, 24, 16, 10)
    no_index = video[: video.index(b"idx1")]
    rows = [(1, video), (2, no_index), (3, None), (4, b"RIFF"), (5, avi.write_avi([], 8, 8)), (6, video[:-100]), (7, video.replace(b"\xff\xd8", b"\xff\xd7"))]
    found = sorted(avi.clips(spark.createDataFrame(rows, "id bigint, clip binary").withColumnRenamed("clip", "m"), "id", "m").collect(), key=lambda r: (r["id"], r["clip"] or 0))
    for i in (1, 2):
        assert [(r["first_frame"], r["n_frames"], r["start_s"], r["end_s"]) for r in found if r["id"] == i] == [(0, 5, 0.0, 0.5), (5, 3, 0.5, pytest.approx(0.8)), (8, 2, pytest.approx(0.8), 1.0)]
    assert [(r["clip"], r["error"] is not None) for r in found if r["id"] > 2] == [(None, False), (None, True), (None, False), (None, True), (None, True)]


# --- pages ---------------------------------------------------------------------


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def text_of(body):
    return html_text.main_text(html_text.read_lines(page(body)))[0]


def test_article_without_furniture():
    body = """<header>Site</header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use</div><div id=ad-top>Buy</div>
    <article><h1>Title &amp; more</h1><p>One <b>two<br>three</b>  &eacute;&#x4e2d;\n four<p>Next<script>var t="</p>";</script> part
    <aside>Side</aside><div class="share-buttons">Tweet</div><form><p>Sign<input></form><p title="a>b">Last <!-- <p>no --> one.</p>
    <ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><section class=comments><p>Me too</p></section><footer>By</footer><p hidden>h</p><p style="display:none">n</p></article><footer>&copy;</footer>"""
    assert text_of(body) == "Title & more\n\nOne two three é中 four\n\nNext part\n\nLast one.\n\nx\n\ny\n\nc1\n\nc2"
    assert text_of("<main><p>a</p></main><p>b") == "a" and text_of("<p>a</p><div class=content><p>b</div>") == "b"
    assert text_of("<p>plain &lt;b&gt; text") == "plain <b> text" and text_of("") == "" and text_of("a < b & c") == "a < b & c"
    assert text_of("<article><p>x</p><blockquote>q</blockquote><pre>a\n  b</pre></article>") == "x\n\nq\n\na b"


def test_main_text_of_all_pages_equals_their_articles(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1|ul|li|div)(?:\s[^>]*)?>", article)]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["n_chars"]) == (r["url"], len(got[r["page_id"]]["text"]))


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = sorted(html_text.common(a, b))
        assert len(got) == brute_lcs(a, b)
        it = iter(b)
        assert all(any(x == a[i] for x in it) for i in got)


def test_alignment_of_lines_that_repeat(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(html_text, "FEW_PAIRS", 0)
    for rows in (1 << 26, 0):
        monkeypatch.setattr(html_text, "ROW_BYTES", rows)
        for _ in range(200):
            a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(2))
            got = sorted(html_text.common(a, b))
            assert len(got) == brute_lcs(a, b)
            it = iter(b)
            assert all(any(x == a[i] for x in it) for i in got)


def test_odd_pages_take_linear_time():
    import time

    def seconds(build, n):
        page_ = build(n)
        began = time.perf_counter()
        lines = html_text.read_lines(page_)
        html_text.main_text(lines, [(1, lines[::-1])])
        return time.perf_counter() - began

    kinds = [lambda n: "<b>" * n + "</u>" * n, lambda n: "<u><article>" + "<b>" * n + "</u>" * n, lambda n: "<b>" * n + "<h1>" * n, lambda n: "<a " * n, lambda n: "<header><div>" * n + "<p>x" * n, lambda n: "<p>x<p>y" * (n // 10), lambda n: "<!-- " * n]
    for build in kinds:
        seconds(build, 1000)
        assert seconds(build, 40_000) < 10 * max(seconds(build, 10_000), 0.05), build(3)


def test_a_near_copy_tells_nothing_about_the_site(spark):
    story = "".join(f"<p>paragraph {i} of a long story that stands at two places</p>" for i in range(20))
    frame = lambda body: page(f"<p>Welcome to the site</p><div>{body}</div>")
    rows = [(1, "http://h.example/a/1", frame(story + "<p>one</p>")), (2, "http://h.example/a/2", frame(story + "<p>two</p>")), (3, "http://h.example/a/3x", frame("<p>something else</p><p>that is long enough</p>"))]
    got = {r["page_id"]: r for r in html_text.extract(pages_of(spark, rows)).collect()}
    assert got[2]["partner_id"] == 3 and got[2]["text"].startswith("paragraph 0") and got[2]["text"].endswith("two") and "Welcome" not in got[2]["text"]
    assert got[1]["partner_id"] is None and got[1]["text"].count("paragraph") == 20  # its only neighbour is a copy
    assert got[3]["partner_id"] == 2 and got[3]["text"] == "something else\n\nthat is long enough"


def test_differencing_deletes_what_neighbours_share(spark, monkeypatch):
    def site(k, own):
        return page(f"<p>Welcome to the site</p><div><p>{own}</p><p>Article {k}</p></div><p>All about us</p>")

    rows = [(k, f"http://h.example/a/{k}", site(k, f"text of {k}")) for k in range(1, 6)]
    rows += [(10, "http://other.example/x", site(10, "alone")), (11, None, site(11, "nowhere")), (12, "http://[bad", site(12, "bad")), (13, "http://h.example/zz/1", None), (14, "http://twin.example/", site(1, "t")), (14, "http://twin.example/", site(1, "t"))]
    want = {k: f"text of {k}\n\nArticle {k}" for k in range(1, 6)}
    full = lambda k, own: f"Welcome to the site\n\n{own}\n\nArticle {k}\n\nAll about us"
    want |= {10: full(10, "alone"), 11: full(11, "nowhere"), 12: full(12, "bad"), 13: "", 14: full(1, "t")}
    for many in (False, True):
        data = rows + ([(100 + i, f"http://big.example/p/{i:04d}", site(100 + i, f"own {i}")) for i in range(900)] if many else [])
        got = html_text.extract(pages_of(spark, data), range_pages=50 if many else 512).collect()
        assert len(got) == len(data)
        assert all(r["text"] == want[r["page_id"]] for r in got if r["page_id"] < 100)
        assert all(r["text"] == f"own {r['page_id'] - 100}\n\nArticle {r['page_id']}" and abs(r["partner_id"] - r["page_id"]) == 1 for r in got if r["page_id"] >= 100)
    assert html_text.extract(pages_of(spark, [])).count() == 0
