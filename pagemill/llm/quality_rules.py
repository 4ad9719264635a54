"""Quality rules: document rules, and host verdicts from shrunk failure rates.

Every whole text gets four measures; rules over them make a document fail.  Per
host, failures are counted by grouped aggregation and the rate is shrunk with a
beta prior fitted to all hosts (method of moments on the hosts' rates, weighted by
their documents).  A host is bad if its posterior mean is above a limit while the
prior gives it enough evidence; its verdict is joined back to its documents.

Only DataFrame functions are used.  Measures stay inside a row: five-word windows
become 64-bit hashes (of the words' hashes) in an array, so nothing is exploded or shuffled; in a
text of n words two different windows share one with a chance below n * n / 2**64, 1e-9 for 100,000 words.  Counts per
host are partial sums before they are shuffled, and the join back is one that
adaptive execution may split, so one host may hold any share of the rows.

Cases: a null text has no words and fails; a null host is a host of its own; very
long texts are one row and take memory in proportion to their words; repeated
rows count each; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stored

#: White space that ends words, symbols that are counted, window length.
SPACE, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 5
WORD_BREAK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def window_hashes(hashes: Column, size: int = WINDOW) -> Column:
    """Hash of each window of ``size`` words, by position, from the words' hashes; empty if there are fewer words."""
    last = F.size(hashes) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))


def repeated_words(pairs: Column, size: int = WINDOW) -> Column:
    """Number of words in windows whose hash occurs twice or more (the first occurrence included).

    ``pairs``: a column of (hash, position), sorted; each is compared with both neighbours.
    """
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), pairs)
    after = F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1)))
    again = F.zip_with(pairs, F.arrays_zip(before.alias("b"), after.alias("a")), lambda p, x: F.when((p["h"] == x["b"]["h"]) | (p["h"] == x["a"]["h"]), p["i"]))
    starts = F.array_sort(F.filter(again, lambda i: i.isNotNull()))
    # a window adds what the next one does not cover
    cover = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["at"])).cast("long").alias("n"), i.alias("at")),
    )
    return cover["n"]


def measures(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(keep)], F.col(text).alias("__text"))
    rows = rows.withColumn("__words", words_of(t)).withColumn("__hashed", F.transform("__words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("__hashes", window_hashes(F.col("__hashed")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    # sorted only where some hash occurs twice; a column of its own, so that it is computed once
    unique = F.size(F.array_distinct("__hashes")) == F.size("__hashes")
    pairs = F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__pairs", F.when(unique, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(pairs))
    return rows.select(
        *[F.col(f"__k{n}").alias(c) for n, c in enumerate(keep)],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__pairs")).alias("n_repeat_words"),
    )


def base_rule(min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    """True where a document fails by its own measures."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def symbol_rule(max_percent: int = 10) -> Column:
    """True where symbols are more than a share of the characters in words."""
    return 100 * F.col("n_symbols") > max_percent * F.col("word_chars")


def host_verdicts(judged: DataFrame, host: str, failed: str, max_rate: float = 0.5, min_strength: float = 2.0) -> DataFrame:
    """host, n_docs, n_failed, rate (posterior mean), bad: one row per host.

    The prior's mean m is the mean failure rate; its strength s = a + b follows from the spread of
    the hosts' rates beyond what sampling gives: s = (m (1 - m) - v) / (v - m (1 - m) * w), where v is
    the document-weighted variance of rates and w = hosts / documents.  Without such spread all
    hosts are alike and get the mean.  s is at least ``min_strength``.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    total = hosts.agg(
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.count("*").alias("hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"),
    ).first()
    n = total["n"] or 0
    mean = (total["f"] or 0) / n if n else 0.0
    spread = (total["squares"] or 0.0) / n - mean * mean if n else 0.0
    noise = mean * (1 - mean) * (total["hosts"] / n if n else 0.0)
    strength = max(min_strength, (mean * (1 - mean) - spread) / (spread - noise)) if spread > noise else float(max(n, 1))
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("bad", F.col("rate") > max_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text: str = "text", max_rate: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, host, host_rate and kept, for every document.

    A host's rate counts documents that fail the base rule or the symbol rule.  Kept are documents
    that pass the base rule and whose host is not bad.
    """
    rows = measures(docs, [id_col, host_col], text)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = stored(rows.withColumn("base_failed", base_rule()).withColumn("rule_failed", base_rule() | symbol_rule()))
    hosts = host_verdicts(rows, "host", "rule_failed", max_rate).select(F.col("host").alias("__host"), "rate", "bad")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("__host")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("bad", F.lit(False))).alias("kept"),
        "host", F.col("rate").alias("host_rate"),
    )
