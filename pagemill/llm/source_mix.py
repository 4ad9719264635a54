"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Sizes (words) are summed per source.  Targets share all words by weight; none is
   above ``max_epochs`` times its source, and the excess goes to the others by weight.
2. Sainte-Lague gives each source an integer quota of words: the highest quotients
   target / (2j + 1) win.  All of them down to a common divisor are taken at once, so
   no list of quotients is made; what is then left or too much is settled quotient by
   quotient.
3. A source's quota is split over its shards, by the same rule and the shards' words.
4. Inside a shard, documents follow each other in a seeded order and the words are
   cut into blocks of ``block_words``, the last one shorter.  Each word is taken
   floor(quota / words) times; the rest of the quota is taken block by block in the
   order of a seeded permutation, and only the last of these blocks is cut.  So how a
   source is cut depends on no other source's size.  No word is taken more than
   ``max_epochs`` times, so no document gives more than that times its words.

Repeated rows (equal id, source and text) are one row with their number until the end, so
however many they are, none of the steps above sees them.  A source has shards in proportion to
its words and to its other rows, whichever asks for more.  Up to ``max_sources`` sources are planned
by the driver, which gets one row of each; more are planned in the cluster, by the same rules
(:func:`plan_in_cluster`).  Of the shards, only those of sources with several come to the driver: at most
about six times ``max_shards`` rows, whatever the input.

Cases: null text has size 0 and gives nothing; a null source is a source of its
own, last in order; repeated rows are separate documents; a document without words
stays in the result with taken 0; an empty table gives an empty result.  Other
columns are not read by :func:`mix_sizes`; :func:`take_words` carries all of them.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shard while there are few; shards grow once there would be more than ``max_shards``.
SHARD_WORDS = 1 << 16


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], max_epochs: int = 3) -> list[float]:
    """Words per source: shares of the total by weight, none above ``max_epochs`` times its size."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        left, weight = total - sum(out[i] for i in range(len(sizes)) if i not in set(free)), sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        over = [i for i in free if share[i] > max_epochs * sizes[i]]
        for i in over or free:
            out[i] = float(max_epochs * sizes[i]) if over else share[i]
        free = [i for i in free if i not in over] if over else []
    return out


def apportion(votes: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Sainte-Lague seats; ties of quotients go to the earlier.  ``caps``: most seats of each."""
    out = [0] * len(votes)
    caps = list(caps) if caps is not None else [seats] * len(votes)
    seats = min(seats, sum(c for v, c in zip(votes, caps) if v > 0))
    ratios = [float(v).as_integer_ratio() if isinstance(v, float) else (int(v), 1) for v in votes]
    unit = max((d for _, d in ratios), default=1)  # denominators are powers of two
    exact = [n * (unit // d) for n, d in ratios]
    wide = 1 << 40  # divisors are whole parts of this

    def given(divisor: int) -> list[int]:  # quotients v / (2j + 1) that are above divisor / wide
        return [min(c, max(0, -((divisor - v * wide) // (2 * divisor)))) if v > 0 else 0 for v, c in zip(exact, caps)]

    if seats > 4 * len(votes):
        low, high = 1, max(exact) * 2 * wide
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(given(mid)) > seats else (low, mid)
        out = given(high)
    heap = [(Fraction(-v, 2 * n + 1), i) for i, (v, n) in enumerate(zip(exact, out)) if v > 0 and n < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (Fraction(-exact[i], 2 * out[i] + 1), i))
    return out


def plan_in_cluster(sources: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """(source, words, rows) with target and seats, for any number of sources: what :func:`targets` and :func:`apportion` do, as aggregates.

    Ranks come from a sort by ranges; the common share per weight, the divisor and the last rank that wins a tie are
    found by searches whose steps are sums over all sources.
    """
    ordered = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ordered = stored(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts, before = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}, {}  # one row per partition
    for part in sorted(counts):
        before[part] = sum(counts[p] for p in before)
    offset = F.broadcast(sources.sparkSession.createDataFrame(list(before.items()), "part int, offset long"))
    rows = ordered.join(offset, "part").withColumn("rank", F.col("at") + F.col("offset"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stored(rows.select("source", "words", "rows", "rank", weight.alias("weight"), (F.col("words") * max_epochs).alias("cap")))

    start = rows.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    share, full = start["words"] / start["weight"], -1
    while True:
        over = F.col("cap") < share * F.col("weight")
        r = rows.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if r["n"] == full or r["weight"] is None:
            break
        full, share = r["n"], (start["words"] - (r["cap"] or 0)) / r["weight"]
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), share * F.col("weight")))
    ends = rows.agg(F.round(F.sum("target")).cast("long").alias("seats"), F.max("target").alias("top")).first()

    def given(divisor: float) -> Column:  # quotients target / (2j + 1) above the divisor
        return F.least(F.col("cap"), F.greatest(F.lit(0), F.ceil((F.col("target") / F.lit(divisor) - 1) / 2))).cast("long")

    def search(low: float, high: float, fits, width: int = 15) -> tuple[float, float]:
        """Neighbours between which ``fits`` turns true; each step tries several places in one aggregate."""
        while True:
            places = sorted({x for x in (low + (high - low) * k / (width + 1) for k in range(1, width + 1)) if low < x < high})
            if not places:
                return low, high
            sums = rows.agg(*[fits(x).alias(f"s{k}") for k, x in enumerate(places)]).first()
            good = [bool(sums[k]) for k in range(len(places))]
            first = good.index(True) if True in good else len(places)
            low, high = places[first - 1] if first else low, places[first] if first < len(places) else high

    if not ends["top"]:
        return rows.select("source", "words", "rows", "target", F.lit(0).cast("long").alias("seats"))
    low, high = search(0.0, 2 * ends["top"], lambda d: F.sum(given(d)) <= ends["seats"])
    left = ends["seats"] - rows.agg(F.sum(given(high))).first()[0]
    # sources that would get one more at the next smaller divisor: equal quotients, which go to the first in order
    tied = given(low if low > 0 else high) > given(high)
    last = -1
    if left > 0:
        most = rows.agg(F.max("rank")).first()[0]
        low_rank, high_rank = -1, most
        while high_rank - low_rank > 1:
            places = sorted({low_rank + (high_rank - low_rank) * k // 16 for k in range(1, 16)} - {low_rank, high_rank})
            sums = rows.agg(*[F.count_if(tied & (F.col("rank") <= x)).alias(f"s{x}") for x in places]).first()
            enough = [x for x, n in zip(places, sums) if n >= left]
            low_rank, high_rank = max([low_rank, *(x for x in places if x not in enough)]), min([high_rank, *enough])
        last = high_rank
    return rows.select("source", "words", "rows", "target", (given(high) + (tied & (F.col("rank") <= last)).cast("long")).alias("seats"))


def _chosen(block: Column, blocks: Column, salt: Column) -> Column:
    """Place of ``block`` in a seeded order of 0 .. blocks - 1: multiplying by a number prime to ``blocks``."""
    step = F.element_at(F.filter(F.array(*map(F.lit, PRIMES)), lambda p: F.pmod(blocks, p) != 0), 1)
    return F.pmod(block * step + F.pmod(salt, blocks), blocks)


#: Steps of the seeded order; their product is above 2**63, so one is prime to any number of blocks.
PRIMES = [7368787, 6972593, 5800079, 4256233]


def mix_sizes(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, block_words: int = 2048, max_shards: int = 1 << 16, max_sources: int = 100_000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and how to cut.

    The cut: the document starts at word ``begin`` of its shard; every word of the shard is taken ``times`` times,
    and ``extra`` words once more, block by block in the seeded order of the ``blocks``.  See :func:`pieces`.
    Of ``copies`` repeated rows, ``nth`` (from 1) says which one it is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(text_col)).alias("text_hash"))
    rows = stored(rows.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("copies")))
    sources = stored(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count("*").alias("rows")))
    totals = sources.agg(F.sum("words").alias("words"), F.sum("rows").alias("rows"), F.count("*").alias("sources")).first()
    if totals["sources"] <= max_sources:
        by_source = sorted(sources.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        words = [r["words"] for r in by_source]
        goal = targets(words, [weights[i % len(weights)] for i in range(len(words))], max_epochs) if totals["words"] else [0.0] * len(words)
        seats = apportion(goal, round(sum(goal)), [max_epochs * w for w in words])
        plan = spark.createDataFrame([(*r, g, s) for r, g, s in zip(by_source, goal, seats)], "source string, words long, rows long, target double, seats long")
    else:
        plan = plan_in_cluster(sources, weights, max_epochs)
    per_shard, per_rows = (max(SHARD_WORDS, -(-(totals[c] or 0) // max_shards)) for c in ("words", "rows"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("words") / per_shard), F.ceil(F.col("rows") / per_rows)).cast("long")
    plan = plan.select(F.col("source").alias("p_source"), shards.alias("shards"), F.col("words").alias("source_size"), "target", "seats")
    # few sources are broadcast: at most max_sources rows of five fields, a proven bound
    rows = rows.join(F.broadcast(plan) if totals["sources"] <= max_sources else plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash")).withColumn("shard", F.pmod("place", F.col("shards")))

    many = rows.where("shards > 1").groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.max("seats").alias("seats")).collect()
    held: dict[str | None, list] = {}
    for r in sorted(many, key=lambda r: r["shard"]):
        held.setdefault(r["source"], []).append(r)
    quota = []
    for source, parts in held.items():
        for r, q in zip(parts, apportion([r["words"] for r in parts], parts[0]["seats"], [max_epochs * r["words"] for r in parts])):
            quota.append((source, r["shard"], r["words"], q))
    # at most six rows of four fields per max_shards: a proven bound
    quotas = F.broadcast(spark.createDataFrame(quota, "q_source string, q_shard long, q_words long, quota long"))
    order = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))
    rows = rows.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
    rows = rows.withColumn("words", F.coalesce("q_words", "source_size")).withColumn("quota", F.coalesce("quota", "seats"))
    some = F.greatest(F.col("words"), F.lit(1))
    rows = rows.withColumns({"blocks": F.ceil(F.col("words") / block_words), "times": _div(F.col("quota"), some), "extra": F.when(F.col("words") > 0, F.col("quota") % some).otherwise(0)})
    rows = rows.withColumn("salt", F.xxhash64(F.lit(seed + 2), "source", "shard")).withColumn("block_words", F.lit(block_words).cast("long"))
    rows = _copies(rows).withColumn("begin", F.col("begin") + (F.col("nth") - 1) * F.col("size"))
    taken = F.aggregate(pieces(), F.lit(0).cast("long"), lambda a, p: a + p["words"] * p["times"])
    return rows.withColumn("taken", taken).select("doc_id", "source", "size", "source_size", "target", "taken", "text_hash", "begin", "words", "blocks", "block_words", "times", "extra", "salt", "nth", "copies")


#: So many repeated rows are made by one task at once.
COPIES = 4096


def _copies(rows: DataFrame) -> DataFrame:
    """One row per copy, with ``nth``; of many copies, each run of :data:`COPIES` is dealt by itself."""
    few = rows.where(F.col("copies") <= COPIES).withColumn("first", F.lit(1).cast("long"))
    lots = rows.where(F.col("copies") > COPIES).withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), "copies", F.lit(COPIES).cast("long")))).repartition("text_hash", "doc_id", "first")
    both = few.unionByName(lots)
    return both.withColumn("nth", F.explode(F.sequence("first", F.least("copies", F.col("first") + COPIES - 1)))).drop("first")


def _div(a: Column, b: Column) -> Column:
    return ((a - a % b) / b).cast("long")


def pieces() -> Column:
    """The parts of a row of :func:`mix_sizes`: array of (start word, words, times), one or two per block it touches."""
    begin, end, length = F.col("begin"), F.col("begin") + F.col("size"), F.col("block_words")
    n = F.greatest(F.col("blocks"), F.lit(1))
    missing = n * length - F.col("words")  # by so much the last block is shorter
    touched = F.when(F.col("size") > 0, F.sequence(_div(begin, length), _div(end - 1, length))).otherwise(F.array().cast("array<bigint>"))

    def parts(b: Column) -> Column:
        place, last = _chosen(b, n, F.col("salt")), _chosen(n - 1, n, F.col("salt"))
        before = place * length - F.when(place > last, missing).otherwise(0)  # words of the blocks in front of it in the order
        first, stop = F.greatest(b * length, begin), F.least((b + 1) * length, end)
        cut = F.least(F.greatest(b * length + F.col("extra") - before, first), stop)  # up to here one time more
        part = lambda x, y, more: F.struct((x - begin).alias("start"), (y - x).alias("words"), (F.col("times") + more).alias("times"))
        return F.array(part(first, cut, 1), part(cut, stop, 0))

    return F.filter(F.flatten(F.transform(touched, parts)), lambda p: p["words"] > 0)


def _runs(copy: Column) -> Column:
    """Runs of words (start, words) that are taken ``copy`` times or more, neighbours joined."""
    taken = F.filter(F.col("__pieces"), lambda p: p["times"] >= copy)
    none = F.array().cast("array<struct<start:bigint,words:bigint>>")

    def add(runs: Column, p: Column) -> Column:
        last = F.element_at(runs, -1)
        joins = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["start"] + F.try_element_at(runs, F.lit(-1))["words"] == p["start"])
        grown = F.struct(last["start"].alias("start"), (last["words"] + p["words"]).alias("words"))
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(grown))).otherwise(F.concat(runs, F.array(F.struct(p["start"].alias("start"), p["words"].alias("words")))))

    return F.aggregate(taken, none, add)


def _numbered(docs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Repeated rows with ``__nth`` (from 1) among the rows of equal key, in the order of a hash of all columns.

    Rows that are equal in all columns may stand for each other, so they are numbered partition by partition: no task
    gets all of them.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = stored(docs.withColumns({"__all": F.xxhash64(*plain), "__part": F.spark_partition_id()}))
    group = [*key, "__all", "__part"]
    rows = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy(F.lit(0))))
    earlier = Window.partitionBy(*key).orderBy("__all", "__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*group).count().withColumn("__before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count").alias("n")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in group]
    both = rows.alias("r").join(sizes, functools.reduce(lambda a, b: a & b, same))
    return both.select("r.*", "__before").withColumn("__nth", F.col("__at") + F.col("__before")).drop("__all", "__part", "__at", "__before")


def take_words(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", n_chars_col: str = "n_chars", max_epochs: int = 3, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with the words taken, one row per run of words and repeat.

    All columns are kept.  A run that is a whole document keeps its text as it was; others keep the
    white space inside.  ``n_chars_col``, if there is one, is set to the new length.
    """
    columns, key = docs.columns, ["__id", "__source", "__hash"]
    mixed = stored(mix_sizes(docs, id_col=id_col, source_col=source_col, text_col=text_col, max_epochs=max_epochs, **options))
    cut = mixed.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), F.col("size").alias("__size"), pieces().alias("__pieces"), F.col("nth").alias("__nth"), F.col("copies").alias("__copies"))
    keyed = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__hash": F.xxhash64(F.lit(options.get("seed", 17)), F.col(text_col))})
    same = lambda *names: functools.reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in names])
    kept = [*[F.col(f"d.`{c}`") for c in columns], "__pieces", "__size"]
    both = keyed.alias("d").join(cut.where("__copies = 1").alias("c"), same(*key)).select(*kept)
    repeated = cut.where("__copies > 1 and __nth = 1").select(*key)
    if repeated.limit(1).count():
        again = _numbered(keyed.alias("d").join(repeated.alias("c"), same(*key), "left_semi"), key)
        both = both.unionByName(again.alias("d").join(cut.where("__copies > 1").alias("c"), same(*key, "__nth")).select(*kept))

    def texts(row: Column) -> Column:  # of all runs and repeats; the text is cut into words once
        return F.transform(row["runs"], lambda r: F.when(r["words"] == row["size"], row["text"]).otherwise(F.ltrim(F.array_join(F.slice(row["units"], (r["start"] + 1).cast("int"), r["words"].cast("int")), ""), F.lit(" \t\n\x0b\x0c\r"))))

    both = both.withColumn("__runs", F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_epochs)), _runs))).where(F.size("__runs") > 0)
    cuts = F.exists("__runs", lambda r: r["words"] != F.col("__size"))
    units = F.when(cuts, F.regexp_extract_all(F.col(text_col), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    row = F.struct(F.col("__runs").alias("runs"), F.col("__size").alias("size"), F.col(text_col).alias("text"), units.alias("units"))
    out = both.withColumn("__text", F.explode(F.get(F.transform(F.array(row), texts), F.lit(0)))).withColumn(text_col, F.col("__text"))
    if n_chars_col in columns:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in columns])
