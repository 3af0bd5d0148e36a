"""N-gram Jaccard self-join (operator 1): T-occurrence search with DivideSkip.

Two documents link when their sets of k-word shingles have a Jaccard similarity of at least
percent / 100. What comes out is each document's class (the components of the links) and how many
documents it links with.

1. Documents of equal sets are one class (equal sets, similarity 1); classes stand for them.
2. Every class posts the first n - T + l of its shingles, T = ceil(n * percent / 100), l = n // 10 and
   at least 1, in one global order: rare shingles by hash, then frequent ones by hash. Two linked
   classes share the first l' posted shingles that they have in common, l' the smaller l of the two;
   as a partner of n has at least T shingles, a class needs T // 10 (at least 1) lists in which a class
   of a size near its own stands too. Classes with fewer have no link and leave the lists. Lists of
   frequent shingles are salted and count without a look at the others.
3. The classes of a list gather round one of them, its centre: that with the largest share of
   frequent shingles, which in a family of near copies is the one that the others derive from.
4. At each centre, in blocks of bounded size, the T-occurrence search with the centre as query finds
   the classes linked with it. Two classes that share a list are either both linked with its centre,
   and so in one component, or one of them is a stray; each stray is a query of its own against
   all that gathered there, in every block. So no link between components is lost.
5. Components of the links found, by hooking labels to smaller neighbours.
6. All links are within components. There every class is a query, against the inverted lists of its
   component; a large one is dealt to blocks by size (sets whose sizes differ by a fifth or more do
   not link) and hash, and each pair of blocks is a task. Only counts leave a task, so no pair is
   ever a row.

The search of a query among gathered sets (DivideSkip): of the inverted lists of the query's shingles
the longest, L in number, are set aside; the others are merged by a heap, and sets that occur T - L times
in them stay candidates. These are looked up in the long lists: lists of a sixteenth of the sets and
more are kept as columns of bits, so that a probe of all of them is one AND and a count of bits; the
others are probed by binary search. Those that reach the overlap that their sizes ask for are linked.

Sets are compared as sets of 64-bit hashes of their shingles. Two different shingles of the texts have
equal hashes with a probability of about 2**-64 a pair; classes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, given_back, gram_hashes, release, small, words_of
from .heavy import BlockCounter, Known, frequent

K, PERCENT = 5, 80
#: Shingles that one block of a centre or a component holds, about.
BLOCK_SHINGLES = 400_000
#: Sets that a task remembers, so as not to post copies again.
SEEN = 200_000
#: Tasks that a frequent shingle's list is dealt to.
LIST_SALTS = 64
#: DivideSkip's constant in L = T / (MU * log2(longest) + 1).
MU = 0.0085
#: Lists of so many sets, and of one in LONG_SHARE of a block's, are columns of bits.
LONG_LEAST, LONG_SHARE = 2, 16


def shingle_set(text: str | None, k: int = K) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    return np.unique(gram_hashes(words_of(text, lower=True), k))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart; the first half names the set in lists, where a false meeting does
    no harm."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def extra(n: int) -> int:
    """How many posted shingles two linked sets of at least n share."""
    return max(1, n // 10)


def needed(n: int, percent: int = PERCENT) -> int:
    """Overlap that any partner of a set of n must reach."""
    return -(-n * percent // 100)


class Gathered:
    """Inverted lists over some sets: for each shingle the numbers of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        shingles = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(shingles, kind="stable")
        shingles, self.owners = shingles[order], owners[order]
        starts = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1])) if len(order) else np.empty(0, np.int64)
        self.shingles, self.starts = shingles[starts], np.append(starts, len(order))
        lengths = np.diff(self.starts)
        long = lengths >= max(LONG_LEAST, -(-len(sets) // LONG_SHARE))
        self.column = np.where(long, np.cumsum(long) - 1, -1)
        held = np.zeros((len(sets), -(-int(long.sum()) // 64) * 64), bool)
        of_entry = np.repeat(self.column, lengths)
        held[self.owners[of_entry >= 0], of_entry[of_entry >= 0]] = True
        self.bits = np.packbits(held, axis=1, bitorder="little").view(np.uint64)

    def search(self, query: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Numbers of the sets whose similarity with the query is at least percent / 100."""
        none = np.empty(0, np.int64)
        t = needed(len(query), percent)
        if t == 0 or not len(self.shingles):
            return none
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        if len(at) < t:
            return none
        columns = self.column[at]
        lists = at[columns < 0]
        columns = columns[columns >= 0]
        lists = lists[np.argsort(self.starts[lists + 1] - self.starts[lists], kind="stable")]
        rest = t - len(columns)  # what lists without a column must give at least
        longest = int(self.starts[lists[-1] + 1] - self.starts[lists[-1]]) if len(lists) else 1
        aside = max(0, min(rest - 1, int(t / (MU * math.log2(longest + 1) + 1)) - len(columns)))
        split = len(lists) - aside
        merged = heap_merged([self.owners[self.starts[i] : self.starts[i + 1]] for i in lists[:split].tolist()])
        if rest - aside > 0:
            candidates, counts = (np.array(x, np.int64) for x in zip(*(m for m in merged if m[1] >= rest - aside), strict=True)) if any(n >= rest - aside for _, n in merged) else (none, none)
        else:
            candidates, counts = np.arange(len(self.sizes)), np.zeros(len(self.sizes), np.int64)
            if merged:
                sets, times = zip(*merged, strict=True)
                counts[list(sets)] = times
        sizes = self.sizes[candidates]
        near = (sizes >= t) & (percent * sizes <= 100 * len(query))
        candidates, counts = candidates[near], counts[near]
        if len(columns):
            mask = np.zeros(self.bits.shape[1] * 64, bool)
            mask[columns] = True
            counts = counts + np.bitwise_count(self.bits[candidates] & np.packbits(mask, bitorder="little").view(np.uint64)).sum(axis=1, dtype=np.int64)
        for k, i in enumerate(lists[split:].tolist()):
            stay = counts + (aside - k) >= t
            candidates, counts = candidates[stay], counts[stay]
            own = self.owners[self.starts[i] : self.starts[i + 1]]
            counts = counts + (own[np.minimum(np.searchsorted(own, candidates), len(own) - 1)] == candidates)
        linked = 100 * counts >= percent * (len(query) + self.sizes[candidates] - counts)
        return candidates[linked]


def heap_merged(lists: list[np.ndarray]) -> list[tuple[int, int]]:
    """The numbers in sorted lists, each once and in order, and in how many lists it stands."""
    return [(x, sum(1 for _ in same)) for x, same in groupby(heapq.merge(*(a.tolist() for a in lists)))]


class Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        """True if x and y were apart."""
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, twin, n) of every row, and (run, n) of shingles that are frequent within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = BlockCounter(), set()
        names = ["kind", "doc_id", "key", "twin", "n"]

        def often(found):
            if found is not None and len(found[0]):
                m = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(found[0]), pa.nulls(m, pa.int64()), pa.array(found[1].astype(np.int64))], names)

        for batch in _texts(batches):
            keys, sizes = [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k)
                keys.append(set_key(s) if len(s) else (None, None))
                sizes.append(len(s))
                if len(s) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    yield from often(counter.add(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), batch.column(0).cast(pa.int64()), *(pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)), pa.array(sizes, pa.int64())], names)
            if len(seen) > SEEN:
                seen.clear()
        yield from often(counter.flush())

    return docs.mapInArrow(lambda batches: given_back(run(batches)), "kind int, doc_id long, key long, twin long, n long")


def _postings(docs: DataFrame, k: int, percent: int, often: np.ndarray) -> DataFrame:
    """(shingle, key, heavy, share, n) for the posted shingles of each set met in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        known = Known(often)
        for batch in _texts(batches):
            parts = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k)
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                heavy = known.among(s)
                posted = len(s) - needed(len(s), percent) + extra(len(s))
                first = np.concatenate([s[~heavy], s[heavy]])[:posted]
                light = min(posted, int((~heavy).sum()))
                parts.append((first, np.full(posted, key[0], np.int64), np.arange(posted) >= light, np.full(posted, 1000 * int(heavy.sum()) // len(s), np.int32), np.full(posted, len(s), np.int32)))
            if parts:
                a, b, c, d, e = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b), pa.array(c), pa.array(d), pa.array(e)], ["shingle", "key", "heavy", "share", "n"])
            if len(seen) > SEEN:
                seen.clear()

    return docs.mapInArrow(lambda batches: given_back(run(batches)), "shingle long, key long, heavy boolean, share int, n int")


def _near_in_size(lists: DataFrame, percent: int) -> DataFrame:
    """The postings beside which another of the list has a size that a link allows."""
    by_size = Window.partitionBy("shingle", "salt").orderBy("n")
    near = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (percent * F.lead("n").over(by_size) <= 100 * F.col("n"))
    return lists.withColumn("near", F.coalesce(near, F.lit(False))).filter("heavy OR near").drop("near")


def _supported(lists: DataFrame, percent: int) -> DataFrame:
    """The postings of classes that stand in as many lists as a link asks for."""
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    enough = lists.groupBy("key", "n").agg(F.count("*").alias("m")).filter(F.col("m") >= least).select("key")
    return lists.join(enough, "key", "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, key, set) of the sets named by ``wanted`` (id, key): the texts are read and moved once for all
    searches, at every size by a shuffle; id is the doc_id of a row with the set of that key."""
    own = docs.join(wanted.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id").select("doc_id", "text", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches):
            rows = []
            for doc, text, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingle_set(text, k)
                if len(s) and set_key(s)[0] == key:
                    rows.append((doc, key, s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["id", "key", "set"])

    return own.mapInArrow(lambda batches: given_back(run(batches)), "id long, key long, set binary")


def _placed(sets: DataFrame, goes: DataFrame) -> DataFrame:
    """A row of each set for each place that ``goes`` (id, key, place, part, more, role) sends it to."""
    return goes.join(sets, ["id", "key"]).select("place", "part", "more", "role", "id", "key", "set")


def _by_place(sets: DataFrame, work, schema: str) -> DataFrame:
    """The rows that ``work`` gives for each (place, part) of ``sets``, from a stream of (more, role, id,
    key, set) by role, id and key, without repeats."""
    names = schema.replace(",", " ").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in _texts(batches):
                yield from zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)

        def once(group):
            last = None
            for _, _, more, role, own, key, data in group:
                if (role, own, key) != last:
                    last = (role, own, key)
                    yield more, role, own, key, np.frombuffer(data, np.uint64)

        found = (r for at, group in groupby(rows(), lambda r: r[:2]) for r in work(at[0], once(group)))
        while part := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(len(names))], names)

    return sets.repartition("place", "part").sortWithinPartitions("place", "part", "role", "id", "key").mapInArrow(run, schema)


CENTRE, MEMBER, QUERY = 0, 1, 2


def _searched(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what was apart within a block (kind 0), and strays (a: centre, b: class,
    key: its set) of centres of more than one block (kind 1)."""

    def block(centre: int, rows: Iterator) -> Iterator[tuple[int, int, int, int]]:
        union, ids, members, keys, mid, index, many = Union(), [], [], [], None, None, False
        for blocks, role, own, key, s in rows:
            if role == CENTRE:
                mid, many = s, blocks > 1
            elif role == MEMBER:
                ids.append(own)
                keys.append(key)
                members.append(s)
            else:
                index = index or Gathered(members)
                for i in index.search(s, percent).tolist():
                    if ids[i] != own and union.join(own, ids[i]):
                        yield 0, own, ids[i], 0
        if mid is None:
            return
        index = Gathered(members)
        linked = set(index.search(mid, percent).tolist())
        for i in linked:
            union.join(centre, ids[i])
            yield 0, centre, ids[i], 0
        for i in range(len(ids)):
            if i in linked:
                continue
            if many:
                yield 1, centre, ids[i], keys[i]
            elif len(ids) > 1:
                for j in index.search(members[i], percent).tolist():
                    if union.join(ids[i], ids[j]):
                        yield 0, ids[i], ids[j], 0

    return _by_place(sets, block, "kind long, a long, b long, key long")


def _counted(sets: DataFrame, percent: int) -> DataFrame:
    """(id, key, links): how many documents of other classes each class links with, a row for each
    task that has it. Rows of role MEMBER are indexed; those of role QUERY ask, or all if there are
    none; ``more`` is how many documents a class stands for."""

    def block(_: int, rows: Iterator) -> Iterator[tuple[int, int, int]]:
        own, weights, members, links, index, asked = [], [], [], None, None, False
        for weight, role, who, key, s in rows:
            if role == MEMBER:
                own.append((who, key))
                weights.append(weight)
                members.append(s)
                continue
            if index is None:
                index, links, asked = Gathered(members), np.zeros(len(own), np.int64), True
                weights = np.array(weights, np.int64)
            hits = index.search(s, percent)
            if len(hits):
                links[hits] += weight
                yield who, key, int(weights[hits].sum())
        if not asked:
            index, weights, links = Gathered(members), np.array(weights, np.int64), np.zeros(len(own), np.int64)
            for i, s in enumerate(members):
                links[i] = weights[index.search(s, percent)].sum() - weights[i]
        yield from ((who, key, int(n)) for (who, key), n in zip(own, links.tolist(), strict=True) if n)

    return _by_place(sets, block, "id long, key long, links long")


def components(links: DataFrame) -> DataFrame:
    """(v, label): for each end of ``links`` (a, b) the smallest end that it reaches.

    Each round every label that has a smaller neighbour label hooks to the smallest one, chains of hooks
    are shortened, and links within one label go; at least half of the labels with open links hook, so
    rounds go with the logarithm of their number. Each step is written out.
    """
    ends = lambda x, y: [F.least(x, y).alias("low"), F.greatest(x, y).alias("high")]
    open_ = cut(links.select(*ends(F.col("a"), F.col("b"))).filter("low < high").distinct(), "open")
    labels = cut(open_.select(F.col("low").alias("v")).union(open_.select("high")).distinct().withColumn("label", F.col("v")), "labels")
    while not open_.isEmpty():
        hooks = [cut(open_.groupBy("high").agg(F.min("low").alias("to")), "hook")]
        for _ in range(2):
            far = hooks[-1].select(F.col("high").alias("__k"), F.col("to").alias("__far"))
            hooks.append(cut(hooks[-1].join(far, F.col("to") == F.col("__k"), "left").select("high", F.coalesce("__far", "to").alias("to")), "hook"))
        hook, before, was = hooks[-1], open_, labels
        low, high = hook.select(F.col("high").alias("low"), F.col("to").alias("__l")), hook.select("high", F.col("to").alias("__h"))
        moved = open_.join(low, "low", "left").join(high, "high", "left").select(*ends(F.coalesce("__l", "low"), F.coalesce("__h", "high")))
        open_ = cut(moved.filter("low < high").distinct(), "open")
        labels = cut(labels.join(hook.withColumnRenamed("high", "label"), "label", "left").select("v", F.coalesce("to", "label").alias("label")), "labels")
        release(before, was, *hooks)
    release(open_)
    return labels


def _dealt(classes: DataFrame, percent: int) -> DataFrame:
    """Where each of ``classes`` (component_id, id, key, n, copies) goes to meet those of its component:
    all to one place, or, of a component of more than BLOCK_SHINGLES, to each pair of blocks with its own.

    Bands of sizes, each 100 / percent times the last, are cut into blocks by hash; a class meets the
    blocks of its band and of the next ones, as sizes further apart do not link.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(100 / percent))).cast("long")
    rows = classes.withColumn("band", band)
    bands = rows.groupBy("component_id", "band").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("component_id"))
    bands = cut(bands.withColumn("whole", total <= BLOCK_SHINGLES).select("component_id", "band", "whole", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("blocks")), "bands")
    at = lambda shift, name: small(bands).select("component_id", (F.col("band") - shift).alias("band"), F.col("blocks").alias(name))
    own = rows.join(small(bands), ["component_id", "band"])
    own = own.join(at(1, "above"), ["component_id", "band"], "left").join(at(-1, "below"), ["component_id", "band"], "left")
    block = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda lower, i, j: F.concat_ws(".", F.col("band") + lower, i, j)
    mine = F.col("block")
    same = F.transform(upto("blocks"), lambda j: F.struct(F.concat_ws(".", F.lit("s"), "band", F.least(mine, j), F.greatest(mine, j)).alias("part"), F.when(mine <= j, MEMBER).otherwise(QUERY).alias("role")))
    over = F.transform(upto("above"), lambda j: F.struct(F.concat_ws(".", F.lit("u"), "band", mine, j).alias("part"), F.lit(MEMBER).alias("role")))
    under = F.transform(upto("below"), lambda j: F.struct(F.concat_ws(".", F.lit("u"), F.col("band") - 1, j, mine).alias("part"), F.lit(QUERY).alias("role")))
    alone = F.array(F.struct(F.lit("all").alias("part"), F.lit(MEMBER).alias("role")))
    goes = own.withColumn("block", block).withColumn("go", F.explode(F.when(F.col("whole"), alone).otherwise(F.concat(same, over, under))))
    return goes.select("id", "key", F.col("component_id").alias("place"), "go.part", F.col("copies").alias("more"), "go.role")


def jaccard_classes(docs: DataFrame, *, k: int = K, percent: int = PERCENT, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of each row of ``docs`` (doc_id, text;
    others are ignored); without ``count`` links are found but not counted, and n_links is left out.

    component_id is the smallest doc_id that links reach from the row, class_id the smallest with
    the same set, n_links how many other rows have a set that links with the row's (copies of its own
    set included; rows of a null doc_id are not counted). Null, empty and wordless texts have 0
    shingles and stay alone; so does a row whose doc_id is null, unless its set is another's too.
    Repeated rows give repeated rows of one class; rows that repeat a doc_id with another text are one
    document with the links of both. An empty table gives no rows. Long texts are taken whole: a set is
    held in one task, never two sets' product.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = cut(_survey(own, k), "survey")
    rows = survey.filter("kind = 0").drop("kind")
    often = frequent(survey.filter("kind = 1").select(F.col("key").alias("run"), "n"))
    own = own.filter("doc_id IS NOT NULL")
    classes = cut(rows.filter("n > 0").groupBy("key", "twin").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.count("doc_id").alias("copies")), "classes")
    named = classes.filter("id IS NOT NULL")

    posted = _postings(own, k, percent, often).withColumn("salt", F.when(F.col("heavy"), F.pmod("key", F.lit(LIST_SALTS))).otherwise(0).cast("int"))
    once = posted.repartition("shingle", "salt").groupBy("shingle", "salt", "heavy", "key", "n").agg(F.max("share").alias("share"))
    near = cut(_near_in_size(once, percent), "lists")
    kept = cut(_near_in_size(_supported(near, percent), percent), "lists")
    release(near)
    lists = _supported(kept, percent).drop("n")
    best = lists.groupBy("shingle", "salt").agg(F.max(F.struct("share", "key")).alias("best"))
    centres = best.groupBy("shingle").agg(F.max("best").alias("best")).select("shingle", F.col("best.key").alias("centre"))
    dealt = best.select("shingle", "salt").join(centres, "shingle")
    pairs = lists.join(dealt, ["shingle", "salt"]).filter("key <> centre").select("centre", "key").distinct()
    middles = named.select(F.col("key").alias("centre"), F.col("id").alias("place"))
    gathers = cut(pairs.join(named.select("id", "key", "n"), "key").join(middles, "centre"), "gathers")
    release(kept)
    parts = cut(gathers.groupBy("place", "centre").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")), "parts")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<string>")).alias("part")
    more = F.col("blocks").cast("long").alias("more")
    role = lambda r: F.lit(r).alias("role")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("string").alias("part")
    members = gathers.join(parts, ["place", "centre"]).select("id", "key", "place", block, more, role(MEMBER))
    mids = parts.select(F.col("place").alias("id"), F.col("centre").alias("key"), "place", each, more, role(CENTRE))
    ends = gathers.select("id", "key").union(parts.select(F.col("place").alias("id"), F.col("centre").alias("key"))).distinct()
    sets = cut(_sets(own, ends, k), "sets")
    first = cut(_searched(_placed(sets, members.union(mids)), percent), "found")
    written = [first]
    links = first.filter("kind = 0").select("a", "b")
    strays = first.filter("kind = 1").select(F.col("a").alias("place"), F.col("b").alias("id"), "key")
    if not strays.isEmpty():
        asks = strays.join(parts, "place").select("id", "key", "place", each, more, role(QUERY))
        open_ = members.join(strays.select("place").distinct(), "place", "left_semi").select(*asks.columns)
        second = cut(_searched(_placed(sets, open_.union(asks)), percent), "found")
        links = links.union(second.select("a", "b"))
        written.append(second)
    release(gathers, parts)
    of_id = components(links)
    release(*written)
    groups = cut(named.join(of_id, F.col("id") == F.col("v")).select(F.col("label").alias("component_id"), "id", "key", "twin", "n", "copies"), "groups")
    release(of_id)
    found = classes.join(groups.select("key", "twin", "id", "component_id"), ["key", "twin", "id"], "left")
    found = found.select("key", "twin", "id", F.coalesce("component_id", "id").alias("component_id"), "copies")
    written = [classes, groups, sets]
    if count:
        links = cut(_counted(_placed(sets, _dealt(groups, percent)), percent).groupBy("id", "key").agg(F.sum("links").alias("links")), "links")
        found = found.join(links, ["id", "key"], "left")
        written.append(links)
    found = cut(found, "found")
    release(*written)
    told = rows.join(found, ["key", "twin"], "left")
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("id", "doc_id").alias("class_id")]
    if count:
        others = F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(0)) - F.when(F.col("doc_id").isNotNull() & F.col("key").isNotNull(), 1).otherwise(0)
        out.append(others.cast("long").alias("n_links"))
    return told.select(*out)


def keep_one(docs: DataFrame, *, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others of any name) without those whose component has a
    smaller doc_id. Rows that repeat a doc_id stay or go together; rows of a null doc_id stay, as
    nothing names them."""
    (gone,) = fresh(docs, "gone")
    found = jaccard_classes(docs, k=k, percent=percent, count=False).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(gone), "left_anti")
