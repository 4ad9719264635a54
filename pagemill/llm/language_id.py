"""Language identification by Bayesian evidence fusion.

Evidence of a document, each as P(evidence | language):

* its text: byte trigrams under a smoothed multinomial per language, and under a
  uniform model for texts in no known language;
* the language that its markup declares;
* the suffix of its address (last label of the host, or a language code in the path); without an address, of its host where that has labels;
* its host's prior, smoothed towards the host's parent domain, and that towards all.

The trigram profiles are fitted to a bounded sample of the rows of each label, however few those are; a label is a
language code of two or three letters, and what follows it ("en-US") does not count.  Everything
else is counted over all documents: one pass scores the texts and stores a narrow
row each; grouped aggregations then count declared languages, suffixes and hosts by
the texts' own best language.  Languages times declared codes are few rows; hosts may
be many, so their priors are joined, by a join that adaptive execution may split.

Cases: a null or empty text and one without a trigram of letters and spaces are of language "und" and
rejected; a null host has a prior of its own; unknown, null or malformed declared
codes are one value each ("other", "none"); repeated rows count each; ties go to the
language that comes first by code point; without labelled rows every document is
"und".  Other input columns are not read by :func:`identify`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._chunks import chunks
from ._store import stored

#: Trigram table size, and the code of texts in no known language.
BUCKETS, UNKNOWN = 1 << 16, "und"
#: A text's evidence counts as that of this many independent trigrams at most: neighbours are not independent.
EFFECTIVE = 64


def trigrams(octets: np.ndarray) -> np.ndarray:
    """Bucket of each three bytes; ASCII letters count as lower case."""
    b = octets.astype(np.uint32)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] * 0x9E3779B1 ^ b[1:-1] * 0x85EBCA6B ^ b[2:] * 0xC2B2AE35) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def has_letter(octets: np.ndarray) -> np.ndarray:
    """Bytes of letters: ASCII letters and all bytes of characters beyond ASCII."""
    return ((octets | 32) >= 97) & ((octets | 32) <= 122) | (octets >= 128)


def says_something(octets: np.ndarray) -> np.ndarray:
    """For each trigram, whether it is of letters and white space only; numbers and signs are of no language."""
    ok = has_letter(octets) | (octets == 32) | ((octets >= 9) & (octets <= 13))
    return ok[:-2] & ok[1:-1] & ok[2:] if len(octets) >= 3 else np.zeros(0, bool)


def count_trigrams(octets: np.ndarray) -> np.ndarray:
    """How often each trigram of letters and spaces occurs."""
    return np.bincount(trigrams(octets)[says_something(octets)], minlength=BUCKETS)


class Profiles:
    """log P(trigram | language) as float32[BUCKETS, languages + 1]; the last column is the uniform model."""

    def __init__(self, counts: Mapping[str, np.ndarray], smoothing: float = 0.1):
        """``counts``: label -> how often each trigram occurs in its rows."""
        self.languages = sorted(counts)
        table = np.full((BUCKETS, len(self.languages) + 1), -math.log(BUCKETS), np.float32)
        for k, lang in enumerate(self.languages):
            shares = counts[lang] + smoothing
            table[:, k] = np.log(shares / shares.sum())
        self.table = table

    @classmethod
    def of_texts(cls, labelled: Sequence[tuple[str, str]]) -> Profiles:
        counts: dict[str, np.ndarray] = {}
        for lang, text in labelled:
            if lang and text:
                counts[lang] = counts.get(lang, 0) + count_trigrams(np.frombuffer(text.encode(), np.uint8))
        return cls(counts)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood per trigram (texts x models) and numbers of trigrams, of joined texts.

        A text without any is best under the uniform model.
        """
        n = len(offsets) - 1
        out, counts = np.zeros((n, self.table.shape[1])), np.zeros(n, np.int64)
        out[:, :-1] = -1
        grams, valid = trigrams(data), says_something(data)
        for k in range(n):
            a, b = offsets[k], max(offsets[k], offsets[k + 1] - 2)
            own = grams[a:b][valid[a:b]]
            counts[k] = len(own)
            if len(own):
                out[k] = 0
                for at in range(0, len(own), 1 << 20):  # bounded memory for long texts
                    out[k] += self.table[own[at : at + (1 << 20)]].sum(axis=0, dtype=np.float64)
                out[k] /= len(own)
        return out, counts


def label_rows(counts: Sequence[int], sample_rows: int, least: int = 50) -> int:
    """Rows to take of each label that has them, so that all labels together give ``sample_rows``; ``least`` at any rate."""
    left, ordered = sample_rows, sorted(counts)
    for k, count in enumerate(ordered):
        share = left // (len(ordered) - k)
        if count > share:
            return max(least, share)
        left -= count
    return max(least, sample_rows)


def fit(docs: DataFrame, label: str = "lang", text: str = "text", sample_rows: int = 2000, id_col: str | None = None, min_rows: int = 1) -> Profiles:
    """Profiles of every label that has ``min_rows`` rows with text in the whole table, however rare it is.

    Labels are counted over all rows.  Each gives its rows with the smallest hash of text and id, as many as
    :func:`label_rows` says: all labels the same number or all they have, about ``sample_rows`` together.  Only rows
    below a cut of the hashes that leaves half as many again are sorted; where repeated rows make it leave too few,
    the label is read again with a wider cut.  Trigrams of the sample are counted in the cluster: what the driver gets is
    a number per label and trigram, however long the texts are.
    """
    rows = docs.select(primary(F.col(label)).alias("l"), F.col(text).alias("t"), F.xxhash64(text, *([id_col] if id_col else [])).alias("h"))
    rows = rows.where(F.col("l").isNotNull() & (F.col("l") != UNKNOWN) & (F.col("t") != ""))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().where(F.col("count") >= min_rows).collect()}
    take = label_rows(list(counts.values()), sample_rows)
    chosen: dict[str, np.ndarray] = {}
    todo, margin = sorted(counts), 1.5
    order = Window.partitionBy("l").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    while todo:
        shares = {x: min(1.0, margin * take / counts[x]) for x in todo}
        cuts = docs.sparkSession.createDataFrame([(x, min((1 << 63) - 1, int((s - 0.5) * (1 << 64)))) for x, s in shares.items()], "cut_l string, cut long")
        below = rows.join(F.broadcast(cuts), (F.col("l") == F.col("cut_l")) & (F.col("h") <= F.col("cut")))
        below = below.groupBy("l", "h").agg(F.min("t").alias("t"), F.count("*").alias("n"))  # repeated rows are one with their number
        weight = F.least(F.col("n"), take - F.coalesce(F.sum("n").over(order), F.lit(0)))
        sample = below.withColumn("weight", weight).where("weight > 0")
        grams = sample.select("l", "t", "weight").mapInPandas(_weighted, "l string, gram int, n long, rows long").groupBy("l", "gram").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
        found: dict[str, int] = dict.fromkeys(todo, 0)
        for r in grams.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("gram", "n"))).alias("grams"), F.sum("rows").alias("rows")).collect():
            table = np.zeros(BUCKETS + 1)
            for gram, n in r["grams"]:
                table[gram] = n
            chosen[r["l"]], found[r["l"]] = table[:BUCKETS], r["rows"]
        todo, margin = [x for x in todo if found[x] < min(take, counts[x]) and shares[x] < 1], margin * 4
    return Profiles(chosen)


def _weighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (l, t, weight) to counts of trigrams per label; the number of rows stands at a trigram that does not exist."""
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text, weight in zip(batch["l"], batch["t"], batch["weight"]):
            table = tables.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
            table[:BUCKETS] += int(weight) * count_trigrams(np.frombuffer(text.encode(), np.uint8))
            table[BUCKETS] += int(weight)
    for label, table in tables.items():
        grams = np.flatnonzero(table)
        yield pd.DataFrame({"l": label, "gram": grams.astype(np.int32), "n": table[grams], "rows": np.where(grams == BUCKETS, table[grams], 0)})


def primary(declared: Column) -> Column:
    """The language code of two or three letters that a declared language starts with, in lower case; else null."""
    return F.nullif(F.lower(F.regexp_extract(declared.cast("string"), r"\A\s*([A-Za-z]{2,3})(?:[-_].*)?\s*\z", 1)), F.lit(""))


def _code(declared: Column, known: Sequence[str]) -> Column:
    code = primary(declared)
    return F.when(declared.isNull(), "none").when(code.isin(*known) if known else F.lit(False), code).otherwise("other")


def address_suffix(address: Column, known: Sequence[str]) -> Column:
    """A known language code that is a part of the path or the first host label, else the last host label; "none" without an address."""
    bare = F.regexp_like(address, F.lit(r"\A[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:[:/?#]|\z)"))
    address = F.when(bare, F.concat(F.lit("//"), address)).otherwise(address)
    host = F.lower(F.regexp_extract(address, r"\A(?:[^/?#]*:)?//([^/?#:]*)", 1))
    codes = "|".join(known) or "(?!)"
    part = F.lower(F.regexp_extract(address, rf"(?i)\A(?:[^/?#]*:)?//(?:[^/?#]*/)*?({codes})(?:[/?#]|\z)", 1))
    last = F.regexp_extract(host, r"([a-z0-9-]+)\z", 1)
    return F.when(part != "", part).when(last != "", last).otherwise("none")


def parent_domain(host: Column) -> Column:
    """The host's last two labels; null if it has no more than those."""
    up = F.regexp_extract(host, r"\.([^.]+\.[^.]+)\z", 1)
    return F.when(up != "", up)


#: Documents whose row changes, up to this number, are broadcast (64 bytes each); beyond it the join is shuffled.
BROADCAST_ROWS = 250_000


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", **options) -> DataFrame:
    """``docs`` without the documents that :func:`identify` rejects, ``declared_col`` set to the language found."""
    found = identify(docs, None, id_col, text_col, declared_col, host_col, **options)
    changed = found.where(~F.col("kept") | ~F.col("lang").eqNullSafe(F.col("declared")))
    changed = changed.select("doc_id", "text_hash", "declared", "host", F.when(F.col("kept"), F.col("lang")).alias("new")).distinct()
    few = changed.count() <= BROADCAST_ROWS
    other = changed.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("declared").alias("__declared"), F.col("host").alias("__host"), F.col("new").alias("__new"), F.lit(True).alias("__changed"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")) & F.col(declared_col).eqNullSafe(F.col("__declared")) & F.col(host_col).eqNullSafe(F.col("__host"))
    both = docs.join(F.broadcast(other) if few else other, same, "left").where("__changed is null or __new is not null")
    return both.withColumn(declared_col, F.coalesce("__new", F.col(declared_col))).select(*[F.col(f"`{c}`") for c in docs.columns])


def score_texts(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, declared, host, address, text_hash, text) with the text replaced by ``ll`` (per model) and ``grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "declared", "host", "address", "text_hash"]
        for batch in batches:
            for at, data, offsets in chunks(batch.column("text")):
                scores, counts = profiles.scores(data, offsets)
                rest = [batch.column(n).slice(at, len(counts)) for n in names]
                own = [pa.array(list(scores), pa.list_(pa.float64())), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*rest, *own], names=[*names, "ll", "grams"])

    return docs.mapInArrow(run, "doc_id long, declared string, host string, address string, text_hash long, ll array<double>, grams long")


def identify(
    docs: DataFrame,
    profiles: Profiles | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    address_col: str | None = None,
    sample_rows: int = 2000,
    min_confidence: float = 0.5,
    strength: float = 20.0,
    min_rows: int = 1,
) -> DataFrame:
    """doc_id, text_hash, host, lang, confidence, text_lang, declared, kept: one row per document.

    ``kept`` is false for "und" and below ``min_confidence``.  ``strength`` is the weight, in documents,
    of a parent's shares in its hosts' priors.  Labels with fewer than ``min_rows`` rows are no known language.
    ``address_col``: where the address is; without one, hosts with labels give the suffix.
    """
    address_col = address_col or host_col
    if profiles is None:
        profiles = fit(docs, declared_col, text_col, sample_rows, id_col, min_rows)
    langs = profiles.languages
    models = [*langs, UNKNOWN]
    column = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), column(declared_col).alias("declared"), column(host_col).alias("host"), column(address_col).alias("address"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = score_texts(rows, profiles)
    # the mean decides how likely a text is; its length, up to EFFECTIVE trigrams, how sure that is
    rows = rows.withColumn("ll", F.transform("ll", lambda x: x * F.least(F.col("grams"), F.lit(EFFECTIVE))))
    best = F.array_max("ll")
    rows = rows.withColumn("top", F.when(F.col("grams") == 0, len(langs)).otherwise(F.array_position("ll", best).cast("int") - 1))
    rows = rows.withColumn("code", _code(F.col("declared"), langs)).withColumn("suffix", address_suffix(F.col("address"), langs) if address_col else F.lit("none"))
    rows = stored(rows.select("doc_id", "text_hash", "declared", "host", "code", "suffix", "ll", "grams", "top"))

    flags = [F.sum((F.col("top") == k).cast("long")).alias(f"n{k}") for k in range(len(models))]
    counts = lambda df: F.array(*[F.col(f"n{k}").cast("double") for k in range(len(models))])

    # declared codes: one row per known language and two more
    declared = {r["code"]: [r[f"n{k}"] for k in range(len(models))] for r in rows.groupBy("code").agg(*flags).collect()}
    total = [sum(c[k] for c in declared.values()) for k in range(len(models))]
    n_codes = len(langs) + 2
    table = {code: [math.log((c[k] + 1) / (total[k] + n_codes)) for k in range(len(models))] for code, c in declared.items()}
    overall = [(t + 1) / (sum(total) + len(models)) for t in total]
    lookup = F.create_map(*[x for code, v in sorted(table.items()) for x in (F.lit(code), F.array(*map(F.lit, v)))]) if table else None

    shares = lambda own, size, parent: F.transform(F.sequence(F.lit(0), F.lit(len(models) - 1)), lambda k: (F.get(own, k) + strength * F.get(parent, k)) / (size + strength))
    everywhere = F.array(*map(F.lit, overall))
    sized = lambda df: df.withColumn("own", counts(df)).withColumn("size", F.aggregate("own", F.lit(0.0), lambda a, x: a + x))
    hosts = sized(rows.groupBy("host").agg(*flags)).select(F.col("host").alias("h"), parent_domain(F.col("host")).alias("up"), "own", "size")
    sums = [F.sum(F.get("own", F.lit(k))).alias(f"n{k}") for k in range(len(models))]
    parents = sized(hosts.where("up is not null").groupBy("up").agg(*sums)).select(F.col("up").alias("parent"), shares(F.col("own"), F.col("size"), everywhere).alias("above"))
    priors = hosts.join(parents, F.col("up") == F.col("parent"), "left")
    priors = priors.select("h", shares(F.col("own"), F.col("size"), F.coalesce("above", everywhere)).alias("prior"))
    out = rows.join(priors, F.col("host").eqNullSafe(F.col("h")), "left")
    if address_col:
        seen = sized(rows.groupBy(F.col("suffix").alias("s")).agg(*flags)).select("s", "own")
        out = out.join(seen, F.col("suffix") == F.col("s"), "left")
        suffix_ll = F.transform(F.sequence(F.lit(0), F.lit(len(models) - 1)), lambda k: F.log((F.get("own", k) + 1) / (F.get(F.array(*[F.lit(float(t)) for t in total]), k) + 50)))
    else:
        suffix_ll = F.array_repeat(F.lit(0.0), len(models))
    said = lookup[F.col("code")] if lookup is not None else F.array_repeat(F.lit(0.0), len(models))
    out = out.withColumn("post", F.zip_with(F.zip_with("ll", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), F.zip_with(said, suffix_ll, lambda a, b: a + b), lambda a, b: a + b))
    out = out.withColumn("most", F.array_max("post"))
    out = out.withColumn("confidence", 1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most"))))
    out = out.withColumn("at", F.when(F.col("grams") == 0, F.lit(len(langs))).otherwise(F.array_position("post", F.col("most")).cast("int") - 1))
    names = F.array(*map(F.lit, models))
    out = out.withColumn("lang", F.get(names, F.col("at"))).withColumn("text_lang", F.get(names, F.col("top")))
    return out.select("doc_id", "text_hash", "host", "lang", "confidence", "text_lang", "declared", ((F.col("lang") != UNKNOWN) & (F.col("confidence") >= min_confidence)).alias("kept"))
