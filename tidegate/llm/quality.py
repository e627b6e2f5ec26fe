"""Quality rules of documents and of their hosts, in DataFrame functions only.

A document's base figures come from one pass over its text; nothing is exploded, so a document's
words never leave its row. Rule failures are then summed by host (the source), each rule's
rates are shrunk by a beta prior fitted to all hosts by moments, and a host whose shrunk rate of
any rule is beyond the limit is rejected; its verdict is joined back to its documents. Hosts have rules of their own beside the base
rules: of symbols, of repeated lines and of the mean length of words. Only narrow figures are shuffled, and only rejected hosts are
joined back: broadcast if they are few, else dealt with a salt, so that a hot host spreads. The figures are written to
the shared folder once, as both the hosts and the join back read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import FEW, SPACE_CLASS, Scratch, join_small, need, quoted

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """body(x) with x bound to the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(grams: Column) -> Column:
    """Number of words in windows of three that occur twice or more; grams: hash of the window that starts at each word."""

    def words_of(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(ordered, words_of)).otherwise(F.lit(0))


def figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with the base figures (long) in columns of these names: FIGURES, and __lines, the number of lines with a word. A null text has no words."""
    need(docs, (text_col,), "quality.figures")
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    keep = [quoted(c) for c in docs.columns if c != text_col and c.lower() not in (*FIGURES, "__t", "__w", "__g", "__lines")]
    rows = docs.select(*keep, text.alias("__t"))
    kept = [quoted(c) for c in rows.columns if c != "__t"]
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    rows = rows.select(
        *kept,
        F.filter(F.split("__t", f"{SPACE_CLASS}+", -1), lambda w: w != "").alias("__w"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("__lines"),
    )
    w = F.col("__w")
    windows = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    rows = rows.select(*kept, "word_chars", "n_symbols", F.col("__lines.dup").cast("long").alias("n_dup_lines"), F.col("__lines.n").cast("long").alias("__lines"), F.size(w).cast("long").alias("n_words"), windows.alias("__g"))
    return rows.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("__g")).cast("long").alias("n_repeat_words"), "__lines")


#: Base rules by name; a document fails the base if it fails one.
def base_rules(min_words: int = 50, repeat_per_cent: int = 50) -> dict[str, Column]:
    return {"too_short": F.col("n_words") < min_words, "repeated": 100 * F.col("n_repeat_words") > repeat_per_cent * F.col("n_words")}


#: Bounds beyond which a text counts against its host: symbols per word, share of repeated lines, mean length of words.
SYMBOLS_PER_CENT, DUP_LINES_PER_CENT, WORD_LENGTH = 10, 30, (2, 15)


def host_rules() -> dict[str, Column]:
    """Rules that judge hosts but not single documents."""
    words, least, most = F.col("n_words"), *WORD_LENGTH
    return {
        "symbols": 100 * F.col("n_symbols") > SYMBOLS_PER_CENT * words,
        "dup_lines": 100 * F.col("n_dup_lines") > DUP_LINES_PER_CENT * F.col("__lines"),
        "word_length": (F.col("word_chars") < least * words) | (F.col("word_chars") > most * words),
    }


def host_rates(rows: DataFrame, host_col: str, rules: list[str]) -> DataFrame:
    """(host, rule, n, failed, rate): the failure rates of hosts, shrunk by each rule's beta prior.

    The prior has the overall rate p as its mean; its strength m comes from the variance between hosts that
    the binomial variance doesn't explain, and is held between 1 and a million documents."""
    sums = rows.groupBy(quoted(host_col).alias("host")).agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules])
    long = sums.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in rules])).alias("x")).select("host", "n", "x.rule", "x.failed")
    total, p = F.col("total").cast("double"), F.col("p")
    prior = long.groupBy("rule").agg(F.sum("n").alias("total"), F.count("*").alias("hosts"), (F.sum("failed") / F.sum("n")).alias("p"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("sq"))
    between = F.greatest(F.col("sq") / total - p * p - p * (1 - p) * (F.col("hosts") - 1) / total, F.lit(1e-12))
    prior = prior.select("rule", "p", F.least(F.greatest(p * (1 - p) / between - 1, F.lit(1.0)), F.lit(1e6)).alias("m"))
    return long.join(prior, "rule").select("host", "rule", "n", "failed", ((F.col("failed") + F.col("m") * p) / (F.col("n") + F.col("m"))).alias("rate"))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: float = 0.5, min_words: int = 50, repeat_per_cent: int = 50) -> DataFrame:
    """docs without its text, with FIGURES, base_failed, host_rejected and kept; input columns of these names give way.

    kept: the base rules hold, and no rule's shrunk failure rate of the host (base_rules and host_rules) is beyond limit. A null
    host is a host of its own. Null texts, empty ones and such of white space only have no words and fail the base. Rows
    are judged one by one, repeated ones and null ids too. Very long texts are judged whole; a row's text is held with its words. A rate
    equal to the limit isn't beyond it. An empty table gives an empty table.
    """
    need(docs, (text_col, host_col), "quality.judge")
    scratch = Scratch(docs.sparkSession, "quality")
    base, hosts = base_rules(min_words, repeat_per_cent), host_rules()
    rules = {f"__{name}": rule for name, rule in (base | hosts).items()}
    taken = {"base_failed", "host_rejected", "kept", "__host", "__of", "__salt", "__bad", *rules}
    keep = [quoted(c) for c in docs.columns if c in (text_col, host_col) or c.lower() not in taken]
    rows = scratch.table(figures(docs.select(*keep), text_col).withColumns(rules).drop("__lines"), "figures")
    bad = host_rates(rows, host_col, list(rules)).groupBy("host").agg(F.max("rate").alias("worst")).where(F.col("worst") > limit)
    bad = scratch.table(bad.select(F.col("host").alias("__host"), F.lit(True).alias("__bad")), "rejected")
    out = join_small(rows, bad, host_col, "__host", bad.limit(FEW + 1).count())
    out = out.withColumn("host_rejected", F.coalesce("__bad", F.lit(False))).drop("__bad")
    failed = F.greatest(*[F.col(f"__{name}") for name in base])
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("host_rejected")).drop(*rules)
