"""Conversation prefix trie (operator 11) by smallest-member ownership.

Every distinct sequence of first turns is a node; the conversations that start with it are its members,
and the smallest of them owns it. A member of a node is a member of all nodes above, so what a conversation
owns is a suffix of its path, and one number, where the suffix begins, tells all of it.

1. Turns get their place in the conversation within ranges of (conv_id, turn), so one long conversation
   is numbered by many tasks; what came before a range is a broadcast of at most two rows a range.
2. A node's key is the exclusive-or of 128-bit hashes of (depth, turn) along its path, a running
   aggregate over buckets of depths. A parent's key is the key without the last turn's hash.
3. Salted windows mark owners: the smallest member and the largest length within (node, salt), then
   among these winners within the node. A hot node is dealt to SALTS groups.
4. One group-by over nodes sums what each member brings: its words from this depth to where its own suffix
   begins (every word of its path less the words it owns, which count once), whether its next node is
   its own (a child), and whether it owns a leaf.
5. Only the first node of a suffix has a parent of another owner; it asks the winner of its salt.
6. The ids that end in a node are joined in runs of 256, and runs are hashed one after the other as they
   stream by; SHA-256 cannot be split, but a node's ids are never held together.

Texts are hashed where they are read and never move. Two different paths are taken for one with a
probability of about 2**-120 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, release, small

#: Fixed values of the contract: conversations of a family share the first turns of its first one.
FAMILY, HEADS = 20, 4
#: Groups that a node's members are dealt to; depths of a bucket; bits of the ids in a run.
SALTS, BUCKET, RUN_BITS = 1024, 1024, 8

KEY = ("depth", "ka", "kb")


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, d1, d2, words): each turn by 120 bits of the SHA-256 of its role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id IS NOT NULL")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    own = own.select("conv_id", "turn", "role", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    half = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    return own.select("conv_id", "turn", "role", half(1).alias("d1"), half(16).alias("d2"), "words")


def numbered(turns: DataFrame) -> DataFrame:
    """The turns with ``pos``, from 1, by turn (null first), role and digest."""
    order = ("turn", "role", "d1", "d2")
    ranged = cut(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    pieces = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a range cuts one conversation at most at each of its ends, so there are two rows a range at most
    split = pieces.withColumn("pieces", F.count("*").over(whole)).withColumn("before", before).filter("pieces > 1 AND before > 0").select("conv_id", "part", "before")
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    placed = ranged.withColumn("at", at).join(F.broadcast(split), ["conv_id", "part"], "left")
    out = cut(placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "d1", "d2", "words"), "numbered")
    release(ranged)
    return out


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Members (conv_id, length) and steps (conv_id, depth, d1, d2, words) of the rebuilt conversations:
    the first h turns of the family's first conversation, then the own turns after the first h; and the
    written tables that the two read."""
    turns = numbered(hashed_turns(conversations))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    first = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "d1", "d2", "words"))).alias("head"))
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    own = own.join(heads, "base", "left")
    taken = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    own = own.withColumn("taken", F.when(F.col("head").isNull(), 0).otherwise(taken)).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = cut(own.select("conv_id", "h", "taken", "length", "head"), "members")
    given = own.filter("taken > 0").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("taken").cast("int"))).alias("t"))
    given = given.select("conv_id", F.col("t.pos").alias("depth"), "t.d1", "t.d2", "t.words")
    rest = turns.withColumn("h", h).filter("pos > h").drop("h").join(own.select("conv_id", "h", "taken"), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "d1", "d2", "words")
    return own.select("conv_id", "length"), given.unionByName(rest), [turns, own]


def _paths(members: DataFrame, steps: DataFrame) -> DataFrame:
    """A row for each member and depth: the node's key (ka, kb), its parent's (pa, pb), words of the last
    turn, words up to it, and the member's length."""
    code = lambda seed: F.xxhash64(F.lit(seed), "depth", "d1", "d2")
    steps = steps.select("conv_id", "depth", "words", code(1).alias("a"), code(2).alias("b"), F.floor((F.col("depth") - 1) / BUCKET).alias("bucket"))
    steps = steps.join(members, "conv_id")
    upto = Window.partitionBy("conv_id", "bucket").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = cut(steps.withColumns({"ka": F.bit_xor("a").over(upto), "kb": F.bit_xor("b").over(upto), "upto": F.sum("words").over(upto)}), "steps")
    sums = steps.filter(F.col("length") > BUCKET).groupBy("conv_id", "bucket").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("words").alias("sum"))
    earlier = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = cut(sums.select("conv_id", "bucket", *(f(c).over(earlier).alias(c) for f, c in ((F.bit_xor, "xa"), (F.bit_xor, "xb"), (F.sum, "sum")))).filter("sum IS NOT NULL"), "earlier")
    whole = steps.join(small(earlier), ["conv_id", "bucket"], "left")
    xor = lambda x, y: F.col(x).bitwiseXOR(F.coalesce(F.col(y), F.lit(0)))
    whole = whole.select("conv_id", "depth", xor("ka", "xa").alias("ka"), xor("kb", "xb").alias("kb"), "a", "b", "words", (F.col("upto") + F.coalesce("sum", F.lit(0))).alias("upto"), "length")
    whole = whole.select("conv_id", "depth", "ka", "kb", xor("ka", "a").alias("pa"), xor("kb", "b").alias("pb"), "words", "upto", "length")
    zero = F.lit(0).cast("long")
    root = members.select("conv_id", *(zero.alias(c) for c in ("depth", "ka", "kb", "pa", "pb", "words", "upto")), "length")
    out = cut(whole.unionByName(root), "paths")
    release(steps, earlier)
    return out


def _ends(paths: DataFrame) -> DataFrame:
    """The key of each node in which conversations end, and the SHA-256 of their ids, ascending, comma-joined."""
    ends = paths.filter("depth = length").withColumn("run", F.shiftright("conv_id", RUN_BITS))
    runs = ends.groupBy(*KEY, "run").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key == at:
                    digest.update(b"," + ids.encode())
                else:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], [*KEY, "ends"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*at, digest.hexdigest()), kinds, strict=True)], [*KEY, "ends"])

    dealt = runs.repartition(*KEY).sortWithinPartitions(*KEY, "run").select(*KEY, "ids")
    return dealt.mapInArrow(hashed, "depth long, ka long, kb long, ends string")


def prefix_trie(members: DataFrame, steps: DataFrame, done: list[DataFrame] | None = None) -> DataFrame:
    """The nodes of the trie of ``members`` (conv_id, length; each once) whose turns are ``steps``
    (conv_id, depth from 1 to length, d1, d2, words): conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Members of length 0 belong to the root alone; without members there is no node. ``done``: written
    tables that nothing reads once the paths are written.
    """
    paths = _paths(members, steps)
    release(*(done or ()))
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    group, node = Window.partitionBy(*KEY, "salt"), Window.partitionBy(*KEY)
    winners = paths.withColumn("salt", salt).withColumn("least", F.min("conv_id").over(group)).withColumn("most", F.max("length").over(group)).filter("conv_id = least")
    winners = cut(winners.withColumn("owner", F.min("conv_id").over(node)).withColumn("deepest", F.max("most").over(node)).drop("least", "most"), "winners")
    owned = winners.filter("conv_id = owner")
    leaf = ((F.col("depth") == F.col("length")) & (F.col("deepest") == F.col("length"))).cast("long")
    suffix = owned.groupBy("conv_id").agg(F.min("depth").alias("from"), F.min_by(F.col("upto") - F.col("words"), "depth").alias("before"), F.max(leaf).alias("leaf"))
    each = paths.groupBy("conv_id").agg(F.max("upto").alias("all"), F.max("length").alias("end")).join(suffix, "conv_id", "left")
    each = cut(each.select("conv_id", F.coalesce("from", F.col("end") + 1).alias("from"), F.coalesce("before", "all").alias("before"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "suffixes")
    child = ((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("from"))).cast("long")
    over = F.greatest(F.lit(0), F.col("before") - F.col("upto") + F.col("words"))
    sums = {"conv_id": F.min("conv_id"), "n_convs": F.count("*"), "n_children": F.sum(child), "n_leaves": F.sum("leaf"), "saved_tokens": F.sum(over)}
    nodes = paths.join(each, "conv_id").groupBy(*KEY).agg(*(v.alias(k) for k, v in sums.items()))
    # the first node of a suffix: a member of its parent, so the parent has a winner of its salt
    first = owned.join(each.select("conv_id", F.col("from").alias("depth")), ["conv_id", "depth"]).filter("depth > 0")
    above = winners.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), "salt", F.col("owner").alias("parent"))
    parents = first.select(*KEY, "pa", "pb", "salt").join(above, ["depth", "pa", "pb", "salt"]).select(*KEY, "parent")
    found = nodes.join(parents, [*KEY], "left").join(_ends(paths), [*KEY], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    ends = F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``conversations`` (conv_id, turn, role, text; others are
    ignored).

    Turns go by turn, null first; equal turns by role, then by the SHA-256 of role and text, so repeated
    rows stay, one after the other. A null role or text is the empty one. Rows of a null conv_id take no
    part. An empty table has no nodes, not even a root. Texts are hashed and counted whole.
    """
    return prefix_trie(*rebuilt(conversations))


#: DuckDB: prefixes as lists of digests, every node put to all nodes above it. The CRC is worked out bit by bit.
SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, role, digest) AS turns FROM t GROUP BY conv_id),
c AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                             lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)), 4294967295) % 4 AS h FROM o),
p AS (SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns FROM c LEFT JOIN o b ON b.conv_id = c.base),
m AS (SELECT conv_id, len(turns) AS length, unnest(range(len(turns) + 1)) AS depth, list_transform(turns, lambda x: x.d) AS path, list_transform(turns, lambda x: x.w) AS words FROM p),
n AS (SELECT list_slice(path, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS w, max(length) AS deepest,
             coalesce(string_agg(CASE WHEN length = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM m GROUP BY ALL),
u AS (SELECT list_slice(node, 1, a) AS above, sum((n_convs - 1) * w)::BIGINT AS saved, count(*) FILTER (deepest = depth) AS leaves, count(*) FILTER (depth = a + 1) AS children
      FROM (SELECT *, unnest(range(depth + 1)) AS a FROM n) GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, u.children AS n_children, u.leaves AS n_leaves, u.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN u ON u.above = n.node LEFT JOIN n q ON n.depth > 0 AND q.node = list_slice(n.node, 1, n.depth - 1)
"""
