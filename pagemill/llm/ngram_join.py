"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Each document is its set of hashed five-word shingles; documents with equal sets are
copies and go on as one, here called a class.  A class has a signature: for each tree of the forest a
sequence of minima.  Trees are sorted prefix tries; two classes are candidates if
they share a prefix in some tree.  The prefix starts at full depth and is shortened
until pairs at the threshold are found with the target recall.

Classes that share a prefix are chained to the smallest of their chain if their signatures
may reach the threshold; where more than ``meeting`` classes share one, all are chained to
the smallest, without a look at signatures.  The chains join to
families (connected components, kept in the cluster).  Only families are verified:
the texts of their representatives are read again, and a family meets in one task.  The meeting
takes the shingles of more than half of its members as a core and works on what each member
lacks of it or has beyond it (:class:`Meeting`): members near the core are linked by these two
numbers alone, and only members that share something outside the core, and are not linked so, are
compared, along inverted lists.  So a family of near copies takes time in proportion to its size,
and every link is counted exactly.  A meeting returns, per class, its number of links and the
smallest member of its linked chain, never its pairs.

A family of more than ``8 * meeting`` classes or ``block_shingles`` shingles is cut into blocks below
both bounds, which meet pairwise: a task's memory is bounded, and what such a family
shuffles is its size times the number of its blocks.  Copies of one text, however many, are one class; their rows
are joined to large classes' results by broadcast, so no task gets all of them.

Cases: a null text is empty; texts without words have no shingles, are linked to
nothing and stand alone; texts of one to four words have one shingle,
of all their words; rows that repeat a text are copies, also under the same
doc_id; null doc_ids sort last as representatives; an empty table gives an empty
result.  Long texts are read whole.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._chunks import CHUNK, chunks
from ._graph import components
from ._store import stored

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=_U)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Shingler:
    """Hashes of the shingles of joined texts, by array operations over all of them."""

    def __init__(self, size: int = 5):
        self.size = size
        self._power = self._inverse = np.ones(1, _U)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._power) < n:
            n = max(n, 2 * CHUNK)
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self._power = np.cumprod(np.r_[_U(1), np.full(n - 1, _BASE, _U)], dtype=_U)
                self._inverse = np.cumprod(np.r_[_U(1), np.full(n - 1, inverse, _U)], dtype=_U)
        return self._power, self._inverse

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ends): text k has the hashes from ends[k] to ends[k + 1]; repeats included."""
        n_docs = len(offsets) - 1
        word = ~_SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.r_[False, word[:-1]] if len(word) else word
        starts = np.flatnonzero(word & (~before | first[:-1]))
        after = np.r_[word[1:], False] if len(word) else word
        ends = np.flatnonzero(word & (~after | first[1:])) + 1
        power, inverse = self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
        words = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        count = np.bincount(doc, minlength=n_docs)
        size = self.size
        if len(words) >= size:
            whole = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])
            value = np.zeros(len(whole), _U)
            for k in range(size):
                value = value * _U(_BASE) + words[whole + k]
            out, of = _mix(value), doc[whole]
        else:
            out, of = np.zeros(0, _U), np.zeros(0, int)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            begin = np.r_[0, np.cumsum(count)]
            value = [_mix(np.array([sum(int(w) * pow(_BASE, k, 1 << 64) for k, w in enumerate(words[begin[d] : begin[d + 1]])) + int(count[d]) & (1 << 64) - 1], _U))[0] for d in short]
            out, of = np.r_[out, np.array(value, _U)], np.r_[of, short]
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
        return out, np.r_[0, np.cumsum(np.bincount(of, minlength=n_docs))]


def recall(similarity: float, trees: int, depth: int) -> float:
    """Chance that a pair of this Jaccard value shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def forest_depth(threshold: float, trees: int, depth: int, target: float) -> int:
    """The prefix length: shortened from ``depth`` until pairs at the threshold have the target recall."""
    while depth > 1 and recall(threshold, trees, depth) < target:
        depth -= 1
    return depth


class Signer:
    def __init__(self, trees: int, depth: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.trees, self.depth = trees, depth
        self.a = rng.integers(1, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def minima(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Minima (documents x functions) as uint32; documents without shingles may not be among them."""
        low, high = hashes.astype(np.uint32), (hashes >> _U(32)).astype(np.uint32)
        out = np.empty((len(ends) - 1, len(self.a)), np.uint32)
        for k, (a, b) in enumerate(zip(self.a, self.b)):
            v = (low ^ b) * a
            v ^= (v >> np.uint32(15)) ^ high
            v *= a
            out[:, k] = np.minimum.reduceat(v, ends[:-1])
        return out

    def buckets(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit number per tree for its prefix."""
        m = minima.reshape(len(minima), self.trees, self.depth).astype(_U)
        value = np.broadcast_to(np.arange(1, self.trees + 1, dtype=_U), m.shape[:2]).copy()
        for k in range(self.depth):
            value = _mix(value * _U(_BASE) + m[:, :, k])
        return value.view(np.int64)


def _sign(docs: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """doc_id, text_hash, key (of the set; null without shingles), shingles (how many), buckets, sig (16 bits of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(size), Signer(trees, depth)
        for batch in batches:
            for at, data, offsets in chunks(batch.column(2)):
                n = len(offsets) - 1
                hashes, ends = shingler.hashes(data, offsets)
                sets = [np.unique(hashes[a:b]) for a, b in zip(ends, ends[1:])]
                keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                some = np.flatnonzero(np.diff(ends))
                buckets, sigs = [None] * n, [None] * n
                if len(some):
                    minima = signer.minima(hashes, np.r_[ends[some], ends[-1]])
                    short = minima.astype("<u2")
                    for d, row, sig in zip(some, signer.buckets(minima), short):
                        buckets[d], sigs[d] = row, sig.tobytes()
                columns = [pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), *columns], names=["doc_id", "text_hash", "key", "shingles", "buckets", "sig"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, key binary, shingles long, buckets array<long>, sig binary")


def _groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal ``keys`` of sorted batches; only the open run is kept between batches."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        bounds = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[a:b])
            last = key
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _meetings(rows: DataFrame) -> DataFrame:
    """Rows of families with block numbers (low, high, own): families of one block meet whole, others block by block."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")
    return rows.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "key")


def _chains(n: int, near) -> list[list[int]]:
    """Connected sets of 0 .. n - 1; ``near(i, rest)`` says which of ``rest`` are next to i."""
    rest, out = np.arange(n), []
    while len(rest):
        chain, rest = [int(rest[0])], rest[1:]
        for i in chain:
            if not len(rest):
                break
            hit = near(i, rest)
            chain += rest[hit].tolist()
            rest = rest[~hit]
        out.append(chain)
    return out


def _chain_edges(members: DataFrame, least: float) -> DataFrame:
    """(u, v): members of a bucket (few) whose signatures have this share of equal minima, each with the smallest of its chain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        us, vs = [], []
        for group in _groups(batches, ["bucket"]):
            if len(group) < 2:
                continue
            keys = group["key"].to_list()
            sig = np.frombuffer(b"".join(group["sig"]), "<u2").reshape(len(keys), -1)
            need = least * sig.shape[1]
            for chain in _chains(len(keys), lambda i, rest: (sig[rest] == sig[i]).sum(axis=1) >= need):
                root = min(keys[i] for i in chain)
                for i in chain:
                    if keys[i] != root:
                        us.append(keys[i])
                        vs.append(root)
            if len(us) > 10_000:
                yield pd.DataFrame({"u": us, "v": vs})
                us, vs = [], []
        yield pd.DataFrame({"u": us, "v": vs})

    dealt = members.select("bucket", "key", "sig").repartition("bucket").sortWithinPartitions("bucket", "key")
    return dealt.mapInPandas(run, "u binary, v binary")


class Meeting:
    """Links inside one list of sets, or between its two blocks.

    With a core C, a member x lacks a of it and has b beyond it; members x and y share at least
    C - a(x) - a(y) shingles, and exactly that and o, the number of things that both lack or both have beyond it.  So
    with the threshold top / bottom and the weight w = bottom a + top b they are linked if and only if
    w(x) + w(y) <= (bottom - top) C + (top + bottom) o.  Without o that is a look-up in the sorted weights.
    """

    def __init__(self, sets: Sequence[np.ndarray], copies: np.ndarray, own: np.ndarray, top: int, bottom: int):
        n = len(sets)
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(n), size)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        core = count * 2 > n
        number = np.cumsum(core) - 1
        total = int(core.sum())
        has = core[column]
        there = np.zeros((n, total), bool)
        there[row[has], number[column[has]]] = True
        lacks, beyond = total - there.sum(axis=1), size - there.sum(axis=1)
        self.weight, self.room, self.gain = bottom * lacks + top * beyond, (bottom - top) * total, top + bottom
        self.copies, self.own, self.two = copies, own, own.min() != own.max()
        # what members lack of the core, and what two or more have beyond it
        rows_lack, what = np.nonzero(~there)
        more = ~has & (count[column] > 1)
        rows, things = np.r_[rows_lack, row[more]], np.r_[what, total + column[more]]
        order = np.lexsort((rows, things))
        self.listed, things = rows[order], things[order]
        cuts = np.flatnonzero(np.r_[True, things[1:] != things[:-1]]) if len(things) else np.zeros(0, int)
        ends = np.r_[cuts[1:], len(things)] if len(things) else cuts
        of = np.repeat(np.arange(len(cuts)), ends - cuts)
        by_row = np.argsort(self.listed, kind="stable")
        self.lists, self.bounds = of[by_row], np.searchsorted(self.listed[by_row], np.arange(n + 1))
        self.starts, self.sizes = cuts, ends - cuts

    def shared(self, x: int) -> np.ndarray:
        """For every member, how much it and x have in common outside the core or lack of it."""
        lists = self.lists[self.bounds[x] : self.bounds[x + 1]]
        sizes = self.sizes[lists]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[lists] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(lists) else np.zeros(0, int)
        return np.bincount(self.listed[at], minlength=len(self.weight))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(copies linked to each member, the first member of its chain)."""
        n, w = len(self.weight), self.weight
        chain, out = np.arange(n), np.zeros(n, np.int64)

        def join(members: np.ndarray) -> None:
            found = np.unique(chain[members])
            if len(found) > 1:
                chain[np.isin(chain, found)] = found[0]

        sides = [np.flatnonzero(self.own == b) for b in np.unique(self.own)]
        for mine, other in zip(sides, sides[::-1]):
            order = other[np.argsort(w[other], kind="stable")]
            sums = np.r_[0, np.cumsum(self.copies[order])]
            out[mine] = sums[np.searchsorted(w[order], self.room - w[mine], side="right")]
            if not self.two:
                out[mine] -= np.where(2 * w[mine] <= self.room, self.copies[mine], 0)
            near = mine[w[mine] + w[order[0]] <= self.room]
            if len(near):
                join(np.r_[near, order[0]])
        lightest = np.array([w[s].min() for s in sides[::-1]])
        side = np.searchsorted(np.unique(self.own), self.own)
        heaviest = np.array([w[s].max() for s in sides[::-1]])
        # a partner beyond the look-up needs something in common; x has no more than this
        most = self.gain * np.diff(self.bounds)
        for x in np.flatnonzero((w + heaviest[side] > self.room) & (w + lightest[side] <= self.room + most)):
            both = self.shared(x)
            near = (w + w[x] > self.room) & (w + w[x] <= self.room + self.gain * both)
            near[x] = False
            if self.two:
                near &= self.own != self.own[x]
            hits = np.flatnonzero(near)
            if len(hits):
                out[x] += self.copies[hits].sum()
                join(np.r_[hits, x])
        return out, chain


def _verified(members: DataFrame, top: int, bottom: int) -> DataFrame:
    """key, links (documents linked to a class by this meeting), root (smallest key of its chain here)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["family", "low", "high"]):
            group = group.drop_duplicates("key")
            keys, sets = group["key"].to_list(), [np.frombuffer(s, "<u8") for s in group["shingles"]]
            links, chain = Meeting(sets, group["copies"].to_numpy(), group["own"].to_numpy(), top, bottom).links()
            root = pd.Series(keys).groupby(chain).transform("min")
            yield pd.DataFrame({"key": keys, "links": links, "root": root.to_numpy(), "split": (group["blocks"] > 1).to_numpy()})

    return members.select("family", "low", "high", "own", "key", "copies", "shingles", "blocks").mapInPandas(run, "key binary, links long, root binary, split boolean")


def _shingles_of(docs: DataFrame, size: int) -> DataFrame:
    """Adds ``shingles`` to rows (wanted, ..., text) whose set has the key ``wanted``; others go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for at, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                hashes, ends = shingler.hashes(data, offsets)
                rows, sets = [], []
                for k, (a, b) in enumerate(zip(ends, ends[1:])):
                    unique = np.unique(hashes[a:b])
                    if wanted[at + k] in seen:  # repeated rows
                        continue
                    if hashlib.blake2b(unique.tobytes(), digest_size=16).digest() == wanted[at + k]:
                        seen.add(wanted[at + k])
                        rows.append(at + k)
                        sets.append(unique.astype("<u8").tobytes())
                part = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], names=["key", "family", "blocks", "copies", "shingles"])

    return docs.mapInArrow(run, "key binary, family binary, blocks long, copies long, shingles binary")


#: Classes of families up to this number are broadcast to the second reading of texts (40 bytes each); beyond it the join is shuffled.
BROADCAST_ROWS = 250_000
#: A class is large from this many documents on, and from a share of all documents that no more than LARGE_CLASSES can have.
LARGE, LARGE_CLASSES = 512, 50_000


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (4, 5), trees: int = 24, depth: int = 8, target_recall: float = 0.9999, meeting: int = 512, block_shingles: int = 1 << 20) -> DataFrame:
    """doc_id, class_id, copy_id, n_links for every document.

    ``threshold`` is a fraction.  ``class_id``: smallest doc_id that links lead to, one for all near
    copies; ``copy_id``: smallest doc_id with the same shingle set; ``n_links``: number of other
    documents at or above the threshold.
    """
    found = _labelled(docs, id_col, text_col, size, threshold, trees, depth, target_recall, meeting, block_shingles)
    return found.select("doc_id", "class_id", "copy_id", "n_links")


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: tuple[int, int], trees: int, depth: int, target_recall: float, meeting: int, block_shingles: int) -> DataFrame:
    """Per document: doc_id, text_hash, grp (key of its class; null without words), class_id, copy_id, n_links."""
    top, bottom = threshold
    level = top / bottom
    prefix = forest_depth(level, trees, depth, target_recall)
    # a signature's share of equal minima is near the Jaccard value; 4.2 standard deviations are allowed
    least = level - 4.2 * math.sqrt(level * (1 - level) / (trees * prefix))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = stored(_sign(rows, size, trees, prefix))
    ids = signed.select("doc_id", "text_hash", "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    classes = signed.where("key is not null").groupBy("key").agg(first, F.count("*").alias("copies"), F.min("shingles").alias("shingles"), F.min("buckets").alias("buckets"), F.min("sig").alias("sig"))
    classes = stored(classes.select("key", F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("rep_hash"), "copies", "shingles", "buckets", "sig"))

    filed = classes.select("key", F.explode("buckets").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count("*").alias("members"), F.min("key").alias("least")).where("members > 1")
    found = filed.join(shared, "bucket").select("bucket", "key", "members", "least")
    all_of = found.where(F.col("members") > meeting).select(F.col("key").alias("u"), F.col("least").alias("v"))
    some_of = found.where(F.col("members") <= meeting).join(classes.select("key", "sig"), "key")
    families = components(_chain_edges(some_of, least).unionByName(all_of)).withColumnsRenamed({"node": "key", "root": "family"})

    members = families.join(classes.select("key", "rep", "rep_hash", "copies", "shingles"), "key")
    sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / (8 * meeting), F.sum("shingles") / block_shingles)).alias("blocks"))
    active = stored(members.join(sizes, "family").select("key", "family", "blocks", "copies", "rep", "rep_hash"))
    wanted = F.broadcast(active) if active.count() <= BROADCAST_ROWS else active
    again = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("key", "family", "blocks", "copies", "text")
    checked = stored(_verified(_meetings(_shingles_of(again, size)), top, bottom))
    links = checked.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("near"))
    joined = components(checked.where("split").select(F.col("key").alias("u"), F.col("root").alias("v")))
    near = links.join(joined, F.col("key") == F.col("node"), "left").select("key", "links", F.coalesce("root", "near").alias("grp"))
    near = near.join(classes.select("key", "rep"), "key")
    heads = near.groupBy("grp").agg(F.min("rep").alias("class_id"))
    near = near.join(heads, "grp").select(F.col("key").alias("n_key"), "links", "class_id", "grp")
    known = classes.select(F.col("key").alias("c_key"), "rep", "copies").join(near, F.col("c_key") == F.col("n_key"), "left").drop("n_key")

    # rows without words need no class; those of large classes get theirs by broadcast, at most LARGE_CLASSES rows; no other class is large
    large = max(LARGE, ids.count() // LARGE_CLASSES)
    words = ids.where("key is not null")
    hot = F.broadcast(known.where(F.col("copies") > large))
    alone = ids.where("key is null").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("rep", "long"), ("copies", "long"), ("links", "long"), ("class_id", "long"), ("grp", "binary"))])
    parts = [
        alone,
        words.join(hot, F.col("key") == F.col("c_key")).drop("c_key"),
        words.join(hot.select("c_key"), F.col("key") == F.col("c_key"), "left_anti").join(known.where(F.col("copies") <= large), F.col("key") == F.col("c_key")).drop("c_key"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(
        "doc_id",
        "text_hash",
        F.coalesce("grp", "key").alias("grp"),
        F.coalesce("class_id", "rep", "doc_id").alias("class_id"),
        F.coalesce("rep", "doc_id").alias("copy_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )


def _holds_map(kind: T.DataType) -> bool:
    """Maps can't be hashed."""
    return "map<" in kind.simpleString()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (4, 5), trees: int = 24, depth: int = 8, target_recall: float = 0.9999, meeting: int = 512, block_shingles: int = 1 << 20) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id (nulls last), then text hash.

    All columns stay.  Of rows with the same id and text one stays, the same in every run; texts without words are groups of their own.
    """
    found = _labelled(docs, id_col, text_col, size, threshold, trees, depth, target_recall, meeting, block_shingles)
    named = found.select(F.col("doc_id").isNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("text_hash").alias("c"), "grp")
    first = named.where("grp is not null").groupBy("grp").agg(F.min(F.struct("a", "b", "c")).alias("h")).select("h.*")
    heads = first.unionByName(named.where("grp is null").select("a", "b", "c")).distinct()
    heads = heads.select(*[F.col(c).alias(f"__{c}") for c in "abc"])
    columns = docs.columns
    keyed = docs.withColumns({"__a": F.col(id_col).isNull(), "__b": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__c": F.xxhash64(text_col)})
    kept = keyed.join(heads, ["__a", "__b", "__c"], "left_semi")
    once = F.row_number().over(Window.partitionBy("__a", "__b", "__c").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not _holds_map(docs.schema[c].dataType)])))
    return kept.withColumn("__n", once).where("__n = 1").select(*[F.col(f"`{c}`") for c in columns])
