"""One query for each operator, over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, html_text, language_id, licenses, packing, quality, source_mix, sstable, warc
from ._base import read
from .ngram_join import ngram_jaccard_join

Query = Callable[[SparkSession, str], DataFrame]

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, sf_dir, "documents"), k=3, per_cent=90)


OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"coalesce({LOWER}, '')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SHA1_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((instr('0123456789abcdef', substr(sha, (5 * i // 4 + 1)::INT, 1)) - 1) * 16 + instr('0123456789abcdef', substr(sha, (5 * i // 4 + 2)::INT, 1)) - 1) >> (3 - 5 * i % 4)::INT) & 31)::INT + 1, 1)), '')"

OP3_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha, max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS keep FROM pages)
SELECT page_id, payload_bytes, {SHA1_BASE32} AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM p
"""


def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents"))


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", *quality.FIGURES, "base_failed", "kept")


OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, {WORDS.format("t")} AS ws FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < 50 AS too_short, 100 * n_repeat_words > 50 * n_words AS repeated, 100 * n_symbols > 10 * n_words AS symbols,
  100 * n_dup_lines > 30 * n_lines AS dup_lines, word_chars < 2 * n_words OR word_chars > 15 * n_words AS word_length FROM f),
hosts AS (
  SELECT source, rule, count(*) AS n, sum(failed::INT)::BIGINT AS failed
  FROM (SELECT source, unnest(['too_short', 'repeated', 'symbols', 'dup_lines', 'word_length']) AS rule, unnest([too_short, repeated, symbols, dup_lines, word_length]) AS failed FROM r) GROUP BY ALL),
sums AS (SELECT rule, sum(n)::DOUBLE AS total, count(*) AS h, sum(failed)::DOUBLE / sum(n) AS p, sum(failed::DOUBLE * failed / n) AS sq FROM hosts GROUP BY rule),
prior AS (SELECT rule, p, least(greatest(p * (1 - p) / greatest(sq / total - p * p - p * (1 - p) * (h - 1) / total, 1e-12) - 1, 1.0), 1e6) AS m FROM sums),
verdict AS (SELECT source, max((failed + m * p) / (n + m)) > 0.5 AS bad FROM hosts JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, too_short OR repeated AS base_failed, NOT (too_short OR repeated) AND NOT bad AS kept
FROM r JOIN verdict ON r.source IS NOT DISTINCT FROM verdict.source
"""


def op7_avi_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.store_texts(read(spark, sf_dir, "documents"))


def op8_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest, root = sstable.write_shards(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return sstable.read_shards(manifest, root).withColumnRenamed("id", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.fold() == 0)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"), "best_license", F.round("best_dice", 9).alias("best_dice"))


_ALL = (op1_ngram_jaccard_join, op2_best_fit_packing, op3_warc_archive, op4_page_differencing, op5_source_mix, op6_host_quality, op7_avi_columns, op8_sstable_tokens, op9_language_id, op10_license_scan)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op3_warc_archive": OP3_SQL, "op6_host_quality": OP6_SQL}
