"""Exact top-k search by inner product (operator 3): an impact-ordered, score-at-a-time index.

Vectors are dealt to shards. In a shard each dimension's postings are ordered by value and cut into
segments, whose quantised impact on a query is the largest product that a value of theirs can give.
A query takes the segments of all dimensions by descending impact over their dimension's least and
adds them to one accumulator a vector. After each round of segments no vector can score more than its
accumulator plus what the dimensions still hold; the bound is compared with the k-th best exact score
so far. A query stops only when this proves that few vectors can still be among the best, and these
possible members are scored exactly. All of it is integer arithmetic in 64 bits.

Vectors with components so large that sums could leave 64 bits stand beside the index: they (and, for a
query of that kind, all vectors) are scored in floating point with a bound of the error, and those that can
be among the best are scored exactly in Python's integers.

A task holds the index of one shard and streams a block of queries past it; shards and blocks are of
like size, so that vectors and queries are copied as seldom as the two allow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SCALE = 256
#: Vectors of a shard, queries of a block, segments of a dimension, rounds of a query.
SHARD, BLOCK, SEGMENTS, ROUNDS = 16_384, 16_384, 16, 8
#: Sums of products in the index stay below 2**SAFE.
SAFE = 60
#: A score is written as three numbers of so many bits, which order like it.
LIMB = 62
#: A query is finished exactly once so small a share of a shard can still be among its best.
FEW = 0.04


class ImpactIndex:
    """The postings of some integer vectors by dimension, in segments of descending value."""

    def __init__(self, vectors: np.ndarray, segments: int = SEGMENTS) -> None:
        self.vectors = vectors
        n, dims = vectors.shape
        self.order = np.argsort(vectors, axis=0, kind="stable")[::-1].astype(np.int32)
        self.cuts = np.unique(np.linspace(0, n, min(segments, n) + 1).astype(np.int64))
        by_value = np.take_along_axis(vectors, self.order, axis=0)
        self.top, self.bottom = by_value[self.cuts[:-1]].T.copy(), by_value[self.cuts[1:] - 1].T.copy()

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of the query's k best (ties: the smaller id), all if fewer."""
        n, dims = self.vectors.shape
        impact = np.maximum(query[:, None] * self.top, query[:, None] * self.bottom)  # dims x segments
        floor = impact.min(axis=1, keepdims=True)
        gain = impact - floor
        base = int(floor.sum())
        order = np.argsort(-gain, axis=None, kind="stable")
        order = order[gain.ravel()[order] > 0]
        seats = np.zeros(n, np.int64)
        unmet = np.sort(gain, axis=1)[:, ::-1]  # what is still to come from a dimension, at most
        done = np.zeros(dims, np.int64)
        best = np.empty(0, np.int64)
        rows = np.arange(n)
        parts = np.array_split(order, ROUNDS)
        for part in parts:
            if len(part):
                dim, seg = np.divmod(part, gain.shape[1])
                sizes = self.cuts[seg + 1] - self.cuts[seg]
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.cuts[seg], sizes)
                np.add.at(seats, self.order[at, np.repeat(dim, sizes)], np.repeat(gain.ravel()[part], sizes))
                done += np.bincount(dim, minlength=dims)
            rest = int(unmet[np.arange(dims), np.minimum(done, gain.shape[1] - 1)][done < gain.shape[1]].sum())
            tried = np.argpartition(-seats, min(4 * k, n - 1))[: 4 * k] if n > 4 * k else rows
            exact = self.vectors[tried] @ query
            exact = np.sort(exact[ids[tried] != own])[::-1]
            if len(exact) < k:
                continue
            possible = base + seats + rest >= exact[k - 1]
            if possible.sum() <= max(8 * k, FEW * n):
                rows = np.flatnonzero(possible)
                break
        else:
            if len(exact) >= k:
                rows = np.flatnonzero(possible)
        rows = rows[ids[rows] != own]
        scores = self.vectors[rows] @ query
        best = np.lexsort((ids[rows], -scores))[:k]
        return rows[best], scores[best]


def best_exact(vectors: np.ndarray, query: np.ndarray, k: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, list[int]]:
    """What :meth:`ImpactIndex.search` gives, for numbers of any size that 64 bits hold."""
    rows = np.flatnonzero(ids != own)
    if not len(rows):
        return rows, []
    real, q = vectors[rows].astype(np.float64), query.astype(np.float64)
    near = real @ q
    off = (np.abs(real) @ np.abs(q)) * (len(q) + 8) * 2.0**-52  # more than all roundings together
    if len(rows) > k:
        floor = np.partition(near - off, len(rows) - k)[len(rows) - k]
        rows = rows[near + off >= floor]
    scores = [sum(a * b for a, b in zip(v, query.tolist(), strict=True)) for v in vectors[rows].tolist()]
    best = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]
    return rows[best], [scores[i] for i in best]


class Shard:
    """The index of some vectors, beside those of them that are too large for it."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        self.width = vectors.shape[1]
        self.most = math.isqrt((1 << SAFE) // max(1, self.width))
        near = (vectors <= self.most).all(axis=1) & (vectors >= -self.most).all(axis=1)
        self.vectors, self.ids, self.near, self.far = vectors, ids, ids[near], np.flatnonzero(~near)
        self.index = ImpactIndex(vectors[near]) if near.any() else None

    def search(self, query: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best, in no order, of the index and of what stands beside it."""
        if not -self.most <= query.min(initial=0) <= query.max(initial=0) <= self.most:
            rows, scores = best_exact(self.vectors, query, k, self.ids, own)
            return list(zip(self.ids[rows].tolist(), scores, strict=True))
        found = []
        if self.index is not None:
            rows, scores = self.index.search(query, k, self.near, own)
            found += zip(self.near[rows].tolist(), scores.tolist(), strict=True)
        if len(self.far):
            rows, scores = best_exact(self.vectors[self.far], query, k, self.ids[self.far], own)
            found += zip(self.ids[self.far][rows].tolist(), scores, strict=True)
        return found


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and code (floor(scale * x) of each component x as a double), without vectors that are
    null, empty or hold a null, a NaN or an infinity (or a component whose code 64 bits do not hold), and
    without rows whose vec_id is null."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < float(1 << 63)))
    there = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return vectors.filter(there).filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("code"))


def _matrix(codes: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, those that are shorter than ``width`` ended by zeros."""
    flat, ends = codes.flatten().to_numpy(), codes.value_lengths().to_numpy()
    out = np.zeros((len(codes), max(width, int(ends.max(initial=0)))), np.int64)
    rows = np.repeat(np.arange(len(codes)), ends)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def top_k(vectors: DataFrame, is_query, *, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all other rows for each row of ``vectors``
    (vec_id, embedding; others are ignored) where ``is_query`` holds.

    Scores are inner products of the quantised vectors (shorter ones count as ending in zeros); ties
    go to the smaller vec_id. A score that leaves 64 bits is null, in its exact rank. Every row but those of the query's own vec_id is a candidate. Rows that
    repeat a vec_id are candidates each; as queries they are asked once, by the first by content. No
    query or no other vector: no rows.
    """
    codes = cut(quantised(vectors, scale), "codes")
    n = codes.count()
    asked = codes.filter(is_query).groupBy("vec_id").agg(F.min("code").alias("code"))
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-codes.filter(is_query).count() // BLOCK))
    own = lambda many: F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    stored = codes.withColumn("shard", own(shards)).withColumn("block", each(blocks)).withColumn("asks", F.lit(0))
    asks = asked.withColumn("block", own(blocks)).withColumn("shard", each(shards)).withColumn("asks", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        mask = (1 << LIMB) - 1
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("shard", "block", "asks")])
            edges = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                part, shard = batch.slice(lo, hi - lo), tuple(place[:2, lo])
                if shard != at:
                    at, held, index = shard, [], None
                if not place[2, lo]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if index is None:
                    width = max(int(h.column("code").value_lengths().to_numpy().max()) for h in held)
                    index = Shard(np.concatenate([_matrix(h.column("code"), width) for h in held]), np.concatenate([h.column("vec_id").to_numpy() for h in held]))
                asking = _matrix(part.column("code"), index.width)[:, : index.width]
                found = [(who, vec, s) for row, who in zip(asking, part.column("vec_id").to_pylist(), strict=True) for vec, s in index.search(row, k, who)]
                columns = [[who for who, _, _ in found], [vec for _, vec, _ in found], [s if -(1 << 63) <= s < 1 << 63 else None for _, _, s in found], [s >> (2 * LIMB) for _, _, s in found], [s >> LIMB & mask for _, _, s in found], [s & mask for _, _, s in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = ["query_id", "vec_id", "score", "high", "middle", "low"]
    met = stored.unionByName(asks).repartition("shard", "block").sortWithinPartitions("shard", "block", "asks").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("middle"), F.desc("low"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB: every query against every other vector.
SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS code FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(256 * x::DOUBLE) >= 9223372036854775808.0)) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.code, v.code), lambda t: coalesce(t[1], 0) * coalesce(t[2], 0))) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, TRY_CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""
