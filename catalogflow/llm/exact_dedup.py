"""Exact dedup (operator 9): skew-safe combining on built-in functions only.

Texts are equal when identical after each run of white space becomes one space. Copies are combined
in three steps, and each compares the whole normalised text beside its digest:

1. locally: the partial aggregation of every map task leaves one row a text;
2. by (digest, text, salt), where the salt is the map task's number: a group of copies that fills a
   third of the table meets in ``salts`` tasks, with at most one row from each map task;
3. by (digest, text): at most ``salts`` rows a text.

Rows find their winner by digest alone; only for a digest that two different texts share (step 3
counts them) do rows carry their text once more. The winners of large groups, those of more than one
part in HOT of all rows (so HOT at most, whatever the table), are broadcast, and the rows of these
groups do not shuffle; no other group is larger than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, cut, fresh

#: At most so many groups are broadcast (48 bytes each).
HOT = 50_000


def normalised(text) -> "F.Column":
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, *, salts: int = 16) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, keep_id, group_size, kept, text_sha256. A null text equals the empty one. A null
    doc_id is larger than any other; a group of null ids only has keep_id null. Of rows that repeat a
    doc_id and its text, one is kept. No input gives no rows.
    """
    rows = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("body")).withColumn("digest", F.unhex(F.sha2(F.col("body"), 256)))
    local = rows.withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("digest", "body", "salt").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    texts = salted.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = cut(texts.select("digest", "keep_id", "group_size"), "winners")
    if winners.groupBy("digest").count().filter("count > 1").isEmpty():
        slim = cut(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("m")), "rows")
        total = winners.agg(F.sum("group_size")).first()[0] or 0
        large = F.col("group_size") * HOT > total
        hot = winners.filter(large & (F.col("group_size") > 1)).withColumnsRenamed({"digest": "of", "keep_id": "k", "group_size": "g"})
        tried = slim.join(F.broadcast(hot), F.col("digest") == F.col("of"), "left")
        found = tried.filter("of IS NOT NULL").select("doc_id", "digest", "m", F.col("k").alias("keep_id"), F.col("g").alias("group_size"))
        rest = tried.filter("of IS NULL").select("doc_id", "digest", "m").join(winners, "digest").select(*found.columns)
        joined = found.unionByName(rest)
    else:  # two texts under one digest: rows find theirs by the whole text
        joined = rows.groupBy("doc_id", "digest", "body").agg(F.count("*").alias("m")).join(texts, ["digest", "body"])
    again = joined.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return again.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, *, salts: int = 16) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others of any name) that :func:`exact_dedup` keeps, with
    their own columns. Of rows that repeat a doc_id and its text the first by the hash of the whole row
    stays, so that reruns agree; rows alike in all columns are one."""
    key, at, order = fresh(docs, "key", "at", "order")
    own = docs.withColumn(key, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    kept = exact_dedup(docs, salts=salts).groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("m")).filter("kept")
    kept = kept.select(F.struct("doc_id", F.unhex("text_sha256").alias("key"), "m").alias(at))
    found = own.join(kept, F.col("doc_id").eqNullSafe(F.col(f"{at}.doc_id")) & (F.col(key) == F.col(f"{at}.key")))
    whole = F.xxhash64(F.to_json(F.struct(*docs.columns)))
    repeated = found.filter(F.col(f"{at}.m") > 1).withColumn(order, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(whole))).filter(F.col(order) == 1)
    return found.filter(F.col(f"{at}.m") == 1).select(*docs.columns).unionByName(repeated.select(*docs.columns))


#: DuckDB: the same rows, from the definition.
SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)
"""
