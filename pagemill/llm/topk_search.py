"""Exact top-k search: an impact-ordered, score-at-a-time index over integer vectors.

Rows are dealt into blocks, and a block into parts.  A part's postings (row, dimension, value) are
filed by impact, the size of the value without its sign, quantised to levels; a segment holds the
postings of one level, and segments are read by falling level.  What is read adds to
accumulators, one per query and row; all queries of a batch read a run of segments at once, as a
product with the postings of that run.  What is unread of a row is at most the product
of the query's length and the length of the row's unread postings (Cauchy and Schwarz), so an
accumulator plus that is an upper bound of the score.  The k rows with the highest
accumulators are scored exactly; with the best of the parts before they give a threshold that the result is not
below.  A query stops once its possible members, the rows whose upper bound reaches the
threshold, are cheaper to rescore than the unread segments to read.  It stops on that proof only,
and all possible members are rescored exactly in whole numbers, so results are exact, ties included.

The queries are a stated set.  They are cut into blocks too, and each block of
queries meets each block of rows in one task: what a task holds is bounded by the
two block sizes.  Each meeting gives k rows a query, so the last ranking reads k rows
per query and block and never a group of all rows.

Cases: vectors that are null or hold null or non-finite components take no
part; neither do vectors whose length differs from the query's as candidates of
it; empty vectors have scores of 0 with each other.  Null ids take no part.  Repeated query rows are one query.  A query's own id is no candidate, repeated rows of
another id are.  Equal scores go to the smaller id.  Fewer candidates than k give
fewer rows.  Components and scores of any size are ranked exactly; those beyond 64 bits are
given as the largest or smallest long.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part, and queries that read a part together.
PART_ROWS, BATCH = 4096, 256
#: A step of the walk ends where this share of the part's squared values is unread.
UNREAD = (0.08, 0.03, 0.01, 0.002)
#: Rescoring one posting costs about as much as reading this many: rows are gathered for it.
RESCORE_COST = 12
_LONG = np.iinfo(np.int64)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, in whole numbers of any size."""
    largest = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (a, b)]
    if largest[0] * largest[1] * a.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    return (a.astype(object) * b.astype(object)).sum(axis=1)


class ImpactPart:
    """Index of one part: ``values`` (n x dims, int64) with ``ids``.  ``read`` and ``held`` count postings for measurements."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, levels: int = 256):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        real = self.values.astype(np.float64)
        impact = np.abs(real)
        top = float(impact.max(initial=0))
        self.step = max(1.0, 2.0 ** np.ceil(np.log2((top + 1) / levels))) if top else 1.0  # width of a level
        level = np.floor(impact / self.step).astype(np.int64)
        energy = real**2
        self.length = np.sqrt(energy.sum(axis=1))
        by_level = np.bincount(level.ravel(), weights=energy.ravel(), minlength=levels + 1) if level.size else np.zeros(1)
        unread = np.r_[0.0, np.cumsum(by_level)][: len(by_level)]  # below each level
        total = float(by_level.sum())
        cuts = sorted({int(np.searchsorted(unread, share * total, side="right") - 1) for share in UNREAD} | {0}, reverse=True)
        mid = np.sign(real) * (level + 0.5) * self.step if self.step > 1 else real  # quantised impact with its sign
        self.steps = []  # (postings of a run of segments, how many, lengths of what is unread of each row then)
        before = np.inf
        for cut in cuts:
            now = (level >= cut) & (level < before)
            self.steps.append((np.where(now, mid, 0.0).T.copy(), int(now.sum()), np.sqrt(np.where(level < cut, energy, 0.0).sum(axis=1))))
            before = cut
        self.read = self.held = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, best: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the k best (scores, ids), best first, without rows of its ``own`` id; ``best``: those of other parts, to be merged."""
        n, dims = self.values.shape
        best = best or [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        real = queries.astype(np.float64)
        length = np.sqrt((real**2).sum(axis=1))
        first, last = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        # what quantising and floating-point sums may be off by
        off = np.abs(real).sum(axis=1) * (self.step / 2 if self.step > 1 else 0) + length * self.length.max(initial=0) * (dims + 8) * 2.0**-50
        acc = np.zeros((len(queries), n))
        going = np.arange(len(queries))
        out = list(best)
        unread = sum(size for _, size, _ in self.steps)
        self.held += unread * len(queries)
        for at, (postings, size, rest) in enumerate(self.steps):
            acc[going] += real[going] @ postings
            unread -= size
            self.read += size * len(going)
            stop = []
            for lot in np.array_split(going, -(-len(going) // BATCH)) if len(going) else []:
                known = acc[lot]
                for row, q in enumerate(lot):
                    known[row, first[q] : last[q]] = -np.inf
                with np.errstate(over="ignore", invalid="ignore"):
                    least = self._threshold(queries, lot, known, k, best)
                    possible = ~(known + length[lot][:, None] * rest + off[lot][:, None] < least[:, None]) & (known > -np.inf)
                ends = (possible.sum(axis=1) * dims * RESCORE_COST <= unread) | (at == len(self.steps) - 1)
                stop.append(ends)
                self._rescore(queries, lot[ends], possible[ends], k, best, out)
            if stop:
                going = going[~np.concatenate(stop)]
        return out

    def _threshold(self, queries: np.ndarray, lot: np.ndarray, known: np.ndarray, k: int, best: list) -> np.ndarray:
        """Per query a score that its result is not below; -inf while there are fewer than k rows."""
        n = known.shape[1]
        take = min(k, n)
        rows = np.argpartition(-known, take - 1, axis=1)[:, :take]
        exact = exact_scores(np.repeat(queries[lot], take, axis=0), self.values[rows.ravel()]).astype(np.float64).reshape(len(lot), take)
        exact[np.take_along_axis(known, rows, axis=1) == -np.inf] = -np.inf
        earlier = np.full((len(lot), k), -np.inf)
        for row, q in enumerate(lot):
            earlier[row, : len(best[q][0])] = best[q][0]
        kth = np.sort(np.c_[exact, earlier], axis=1)[:, -k]
        return np.nextafter(kth * (1 - np.sign(kth) * 2.0**-50), -np.inf)

    def _rescore(self, queries: np.ndarray, lot: np.ndarray, possible: np.ndarray, k: int, best: list, out: list) -> None:
        which, rows = np.nonzero(possible)
        scores = [exact_scores(queries[lot[which[a : a + 8192]]], self.values[rows[a : a + 8192]]) for a in range(0, len(rows), 8192)]
        self.read += len(rows) * self.values.shape[1]
        score = np.concatenate(scores) if scores else np.zeros(0, np.int64)
        cuts = np.searchsorted(which, np.arange(len(lot) + 1))
        for i, q in enumerate(lot):
            s, ids = np.r_[best[q][0], score[cuts[i] : cuts[i + 1]]], np.r_[best[q][1], self.ids[rows[cuts[i] : cuts[i + 1]]]]
            order = sorted(range(len(s)), key=lambda j: (-s[j], ids[j])) if s.dtype == object else np.lexsort((ids, -s))
            out[q] = s[order[:k]], ids[order[:k]]


def _matrix(column: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length: length -> (positions, matrix)."""
    size = column.map(len).to_numpy()
    return {int(s): (at := np.flatnonzero(size == s), np.array(column.iloc[at].to_list(), np.int64).reshape(len(at), int(s))) for s in np.unique(size)}


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that take part."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    # cut to 64 bits, what floor alone refuses
    cut = lambda c: F.greatest(F.least(F.lit(float(scale)) * c.cast("double"), F.lit(9.2233720368547748e18)), F.lit(-9.2233720368547748e18))
    ints = F.transform(x, lambda c: F.floor(cut(c)))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), ints.cast("array<bigint>").alias("v"))


def search_block(ids: np.ndarray, values: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, score, id) of the k best of each query, part after part, each with the thresholds of those before."""
    best = None
    for at in range(0, len(ids), PART_ROWS):
        best = ImpactPart(ids[at : at + PART_ROWS], values[at : at + PART_ROWS]).search(queries, own, k, best)
    for q, (scores, found) in zip(own.tolist(), best or []):
        for s, i in zip(scores.tolist(), found.tolist()):
            yield q, max(min(s, _LONG.max), _LONG.min), i


def topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block_rows: int = 65_536, block_queries: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row.

    ``is_query`` selects queries by the id column (named ``vec_id`` there).  ``block_rows`` and
    ``block_queries`` bound a task's memory; blocks of rows are smaller where the cluster has more cores than blocks.
    """
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_groups = -(-sizes["q"] // block_queries) or 1
    spread_rows = max(PART_ROWS, -(-sizes["n"] * n_groups // vectors.sparkSession.sparkContext.defaultParallelism))
    n_blocks = -(-sizes["n"] // min(block_rows, spread_rows)) or 1
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n)).cast("int")
    # rows go to each block of queries, queries to each block of rows
    data = rows.select(spread(n_blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("grp"), F.lit(0).alias("side"), "vec_id", "v")
    asked = rows.where(is_query).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), spread(n_groups, 2).alias("grp"), F.lit(1).alias("side"), "vec_id", "v")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        queries, side = pdf[pdf["side"] == 1], pdf[pdf["side"] == 0]
        asked_by_size = _matrix(queries["v"])
        for size, (at, matrix) in _matrix(side["v"]).items():
            if size in asked_by_size:
                of, vectors_ = asked_by_size[size]
                out += search_block(side["vec_id"].to_numpy()[at], matrix, vectors_, queries["vec_id"].to_numpy()[of], k)
        return pd.DataFrame(out, columns=["query_id", "score", "vec_id"]).astype("int64")

    found = data.unionByName(asked).groupBy("block", "grp").applyInPandas(meet, "query_id long, score long, vec_id long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
