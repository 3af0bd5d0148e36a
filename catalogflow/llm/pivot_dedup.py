"""Embedding near-dedup (operator 13): a pivot-permutation index.

1. Equal vectors of a label are one class; classes stand for them, with a weight.
2. PIVOTS reference points are drawn from the vectors. A class is described by its NEAREST pivots, in
   order of distance. Two vectors at the least cosine share most of them: how many, at least, is
   fitted on a bounded sample, each vector of which is moved by exactly that angle towards another one. If
   too few are shared (few dimensions, many pivots), there are fewer pivots.
3. Inverted pivot lists: two classes that share s of m pivots (in the pivots' global order) share their first
   two among the first m - s + 2 of each. So a class is posted to the lists of all pairs of those, of
   its label. Lists of one class go before vectors move.
4. Within a list the shared pivots of two classes are counted; those that share enough, and have no
   earlier pair of pivots in common (so each pair is looked at once), are verified by their cosine.
5. A long list is dealt to blocks, and each pair of blocks is a task. Counts of links and links that join
   what was apart leave a task, so no pair within a group of copies is ever a row.
6. Components of the links.

What is found has a cosine of the least or more; what is missed are linked vectors that share fewer pivots
than any of the sample. Work in a dense group stays quadratic, as each of
its links is verified to be counted; it is spread over blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, small
from .ngram_join import components

COSINE = 0.98
#: Pivots at most, and pivots that describe a vector. The pivots and the sample that fits them are the first
#: vectors by hash: 2 * PIVOTS vectors reach the driver, PIVOTS go to each task.
PIVOTS, NEAREST = 512, 8
#: Shared pivots that a fit must reach at least.
LEAST_SHARED = 3
#: Classes of a block of a list.
BLOCK = 2048


def _units(batches: Iterator[pa.RecordBatch], width: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, the unit vectors of their last column (shorter ones end in zeros) and
    which rows have one: not those that are null, zero, or hold a null, a NaN or an infinity."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            lists = batch.column(batch.num_columns - 1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is a NaN
            x = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)), 1)))
            x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            most = np.abs(x).max(axis=1)
            sound = np.isfinite(x).all(axis=1) & (most > 0)
            x[~sound] = 0
            x /= np.where(sound, most, 1)[:, None]  # so that no square leaves the range
            yield batch, x / np.where(sound, np.sqrt((x * x).sum(axis=1)), 1)[:, None], sound


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, digest, unit): digest and unit vector are null where the row links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, sound in _units(batches):
            sound &= batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            # zeros at the end do not tell vectors apart
            ends = [row[: np.flatnonzero(row)[-1] + 1].tobytes() if ok else None for row, ok in zip(x, sound.tolist(), strict=True)]
            digests = [e and hashlib.blake2b(e, digest_size=16).digest() for e in ends]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(ends, pa.binary())], ["vec_id", "label", "digest", "unit"])

    label = vectors.schema["label"].dataType.simpleString()
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(run, f"vec_id long, label {label}, digest binary, unit binary")


def _matrix(units: list[bytes], width: int = 0) -> np.ndarray:
    out = np.zeros((len(units), max([width, 1, *(len(u) // 8 for u in units)])))
    for row, u in zip(out, units, strict=True):
        row[: len(u) // 8] = np.frombuffer(u)
    return out


def nearest(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """For each row the numbers of its m nearest pivots, nearest first (ties: the smaller number)."""
    width = max(x.shape[1], pivots.shape[1])
    near = np.pad(x, ((0, 0), (0, width - x.shape[1]))) @ np.pad(pivots, ((0, 0), (0, width - pivots.shape[1]))).T
    return np.argsort(-near, axis=1, kind="stable")[:, :m]


def thinned(sample: np.ndarray, cosine: float) -> np.ndarray:
    """The sample without what is near to an earlier one, so that a group of near copies gives one pivot."""
    near = sample @ sample.T >= cosine
    kept = np.zeros(len(sample), bool)
    for i in range(len(sample)):
        kept[i] = not (near[i, :i] & kept[:i]).any()
    return sample[kept]


def fitted(sample: np.ndarray, cosine: float = COSINE, most: int = PIVOTS, m: int = NEAREST) -> tuple[np.ndarray, int]:
    """Pivots out of the thinned sample, and how many of the m nearest ones two vectors at the least
    cosine share: the fewest that any probe shares.

    Probes are the sample's vectors, each beside what it becomes when it is moved to exactly that cosine
    towards another of the sample (so that probes stay where the data are).
    """
    draw = np.random.default_rng(20240517)
    sample = thinned(sample, cosine)
    if len(sample) < 2:
        return sample, min(m, len(sample))
    probes = np.repeat(sample, max(1, 2 * most // len(sample)), axis=0)
    away = sample[draw.integers(0, len(sample), len(probes))]
    away = away - (away * probes).sum(axis=1, keepdims=True) * probes
    size = np.sqrt((away * away).sum(axis=1, keepdims=True))
    moved = (size > 1e-9).ravel()
    probes, away = probes[moved], (away / np.maximum(size, 1e-9))[moved]
    beside = cosine * probes + np.sqrt(max(0.0, 1 - cosine * cosine)) * away
    count = min(most, len(sample))
    while count > m:
        a, b = nearest(probes, sample[:count], m), nearest(beside, sample[:count], m)
        shared = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))
        least = int(shared.min()) if len(shared) else m
        if least >= min(m, LEAST_SHARED):
            return sample[:count], least
        count //= 2
    return sample[: min(m, len(sample))], min(m, len(sample))  # all pivots describe every vector


def posted(near: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and second pivot of the lists that each row is posted to. Of a single pivot the second is
    the first."""
    ordered = np.sort(near, axis=1)
    m = ordered.shape[1]
    pairs = list(combinations(range(min(m, m - shared + 2)), 2)) if min(m, shared) > 1 else [(i, i) for i in range(m - shared + 1)]
    first, second = ordered[:, [i for i, _ in pairs]], ordered[:, [j for _, j in pairs]]
    return np.repeat(np.arange(len(near)), len(pairs)), first.ravel(), second.ravel()


def _holds(near: np.ndarray, pivots: int) -> np.ndarray:
    out = np.zeros((len(near), pivots), np.float32)
    out[np.arange(len(near))[:, None], near] = 1
    return out


def candidates(near_a: np.ndarray, near_b: np.ndarray, first: int, second: int, shared: int, pivots: int) -> np.ndarray:
    """Which pairs share enough pivots, the list's two before all others that they share."""
    a, b = _holds(near_a, pivots), _holds(near_b, pivots)
    earlier = second + 1
    return (a @ b.T >= shared) & (a[:, :earlier] @ b[:, :earlier].T == (1 if first == second else 2))


def _spanning(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the rows of a symmetric matrix into its components."""
    open_ = np.ones(len(linked), bool)
    for start in range(len(linked)):
        if not open_[start]:
            continue
        open_[start], todo = False, [start]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & open_)
            open_[new] = False
            todo += new.tolist()
            yield from ((at, int(j)) for j in new)


def _searched(goes: DataFrame, shared: int, pivots: int, cosine: float) -> DataFrame:
    """(node, links, other): how many vectors of other classes a task found linked with a class (other is
    null), or a link that joins (links is null); from (label, first, second, low, high, block, node,
    copies, near, unit)."""
    keys = ["label", "first", "second", "low", "high"]

    def group(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        own = np.array([r[5] == key[3] for r in rows])
        nodes, copies = np.array([r[6] for r in rows], np.int64), np.array([r[7] for r in rows], np.int64)
        near = np.frombuffer(b"".join(r[8] for r in rows), np.int16).reshape(len(rows), -1)
        x = _matrix([r[9] for r in rows])
        a = np.flatnonzero(own)
        b = a if key[3] == key[4] else np.flatnonzero(~own)
        if not len(a) or not len(b):
            return
        found = candidates(near[a], near[b], key[1], key[2], shared, pivots)
        if found.any():
            found &= x[a] @ x[b].T >= cosine
        if a is b:
            found |= found.T
            np.fill_diagonal(found, False)
        if not found.any():
            return
        whole = found
        if a is not b:
            whole = np.zeros((len(rows), len(rows)), bool)
            whole[np.ix_(a, b)], whole[np.ix_(b, a)] = found, found.T
        order = a if a is b else np.arange(len(rows))
        links = whole @ copies[order]
        yield from ((int(nodes[order[i]]), int(links[i]), None) for i in np.flatnonzero(links))
        yield from ((int(nodes[order[i]]), None, int(nodes[order[j]])) for i, j in _spanning(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["node", "links", "other"])

        at, held, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                if row[:5] != at:
                    if at is not None:
                        out += group(at, held)
                    at, held = row[:5], []
                held.append(row)
                if len(out) > 50_000:
                    yield told(out)
                    out = []
        if at is not None:
            out += group(at, held)
        yield told(out)

    columns = [*keys, "block", "node", "copies", "near", "unit"]
    return goes.repartition(*keys).sortWithinPartitions(*keys).select(*columns).mapInArrow(run, "node long, links long, other long")


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE, pivots: int = PIVOTS, m: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label; others
    are ignored): how many other rows of its label have a vector of that cosine or more, the smallest
    vec_id that links reach, and whether it is the row's own.

    Rows without a label, and vectors that are null, empty, zero or hold a null, a NaN or an infinity,
    have no links and stay alone. Shorter vectors count as ending in zeros. Rows that repeat a vec_id are
    vectors each; rows of a null vec_id link too, name no component, and are kept. Vectors of one
    direction and label are copies (cosine 1) and link with one another. An empty table gives no rows.
    """
    rows = cut(_rows(vectors), "vectors")
    sound = rows.filter("digest IS NOT NULL")
    found = sound.groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = cut(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    sample = _matrix([bytes(r.unit) for r in classes.select("unit", F.xxhash64("digest").alias("h")).orderBy("h", "unit").limit(2 * pivots).collect()])
    chosen, shared = fitted(sample, cosine, pivots, m)
    many, m = len(chosen), min(m, len(chosen))
    label = vectors.schema["label"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                near = nearest(_matrix(batch.column(2).to_pylist(), chosen.shape[1]), chosen, m).astype(np.int16)
                who, first, second = posted(near, shared)
                texts = pa.array([row.tobytes() for row in near], pa.binary())
                each = [batch.column(i).take(pa.array(who)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*each, pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), texts.take(pa.array(who))], ["label", "node", "first", "second", "near"])

    postings = cut(classes.select("label", "node", "unit").mapInArrow(describe, f"label {label}, node long, first int, second int, near binary"), "postings")
    lists = ["label", "first", "second"]
    sizes = cut(postings.groupBy(*lists).agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "lists")
    blocks = postings.join(small(sizes), lists).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    goes = blocks.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("blocks", "with")
    goes = goes.join(classes.select("node", "copies", "unit"), "node")
    told = cut(_searched(goes, shared, many, cosine), "found")
    release(postings, sizes)
    counts = told.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(told.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"v": "node", "label": "root"})
    known = classes.drop("unit").join(counts, "node", "left").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = cut(known, "known")
    release(told, classes)
    of_root = known.groupBy("root").agg(F.min("id").alias("component_id"))
    known = known.join(of_root, "root").select("label", "digest", "copies", "links", "component_id")
    out = rows.select("vec_id", "label", "digest").join(known, ["label", "digest"], "left")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
