"""Mixing sources to target weights (operator 7), on built-in functions only.

Words are summed by source (map-side combined, so a hot source is one row a task), the targets are
water-filled under a cap over one row a source, and each document is emitted floor(rate) times plus
once more if its own hash falls below the fraction.

Draws of few documents of very different lengths would miss a target by much. So the fraction is moved
to the point of the draws, to one part in DRAWS, where the words of the copies come nearest to what
the fraction asks for; of many documents that point is the fraction itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, fresh, small

#: Salts of the join with the rates where their table is too large to broadcast.
SALTS = 32
#: Steps of a draw: three hexadecimal digits of a SHA-256.
DRAWS = 4096
SEED = "mix-1"


def word_count(text) -> "F.Column":
    """Words of a text: each becomes one x, then the white space goes."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3) -> DataFrame:
    """Targets for (source, source_size): shares of the total by weight, at most max_rate times a
    source's own size, what is above shared again by weight.

    Sources take the weights in turn by code point, null last. With the sources ordered by cap over
    weight, those that stop at their cap are a prefix; the first whose cap is not below its share
    fixes the share of the rest. One row a source passes through the window. Sizes of 0 give 0.
    """
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_rate)
    by_room = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = F.max("share").over(everything)
    return ranked.withColumn("share", left / open_weight).withColumn("target", F.round(F.least(F.col("cap").cast("double"), level * F.col("w")), 6)).select("source", "source_size", "target")


def _draw(seed: str) -> "F.Column":
    """0 to DRAWS - 1, from the document's id, or from its text where the id is null."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), named), 256), 1, 3), 16, 10).cast("int")


def source_rates(drawn: DataFrame, **kind) -> DataFrame:
    """source, source_size, target, whole and cutoff from (source, draw, words), a row a step of the
    draws: a document is taken ``whole`` times, and once more if its draw is below ``cutoff``."""
    sizes = drawn.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, **kind)
    most = F.lit(float(kind.get("max_rate", 3)))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), most)).otherwise(0.0)
    rates = targets.withColumn("whole", F.floor(rate).cast("int")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    same = F.col("source").eqNullSafe(F.col("of"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("draw"))
    steps = drawn.withColumn("words", upto).unionByName(sizes.select("source", F.lit(-1).alias("draw"), F.lit(0).cast("long").alias("words")))
    near = steps.join(rates.select(F.col("source").alias("of"), "need"), same).groupBy("source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("need")).alias("off"), (F.col("draw") + 1).alias("cutoff"))).alias("s"))
    return rates.join(near.select(F.col("source").alias("of"), "s.cutoff"), same).select("source", "source_size", "target", "whole", F.when(F.col("whole") < most, F.col("cutoff")).otherwise(0).alias("cutoff"))


def mix(docs: DataFrame, *, out: str = "mix", weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with a struct ``out`` of size, source_size, target and copies.

    copies is how often the mix takes the document: 0 to max_rate, the same in every run, as it
    hangs on the table and ``seed`` alone. A source's words taken differ from its target by half the
    words of one step of the draws at most (a step holds one document, or one part in DRAWS of a large
    source). Null or wordless texts have size 0 and are taken like any other of their source; a source
    of no words at all has rate 0. A null source is a source of its own; a null doc_id draws by its text.
    Rows that repeat a doc_id draw alike. An empty table gives no rows. A column of ``docs`` may have any
    name but ``out``.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {out}")
    own = docs.select(F.struct("*").alias("row"), "source", word_count(F.col("text")).alias("size"), _draw(seed).alias("draw"))
    drawn = cut(own.groupBy("source", "draw").agg(F.sum("size").alias("words")), "draws")
    rates = cut(source_rates(drawn, weights=weights, max_rate=max_rate).withColumnRenamed("source", "of"), "rates")
    same, fit = F.col("source").eqNullSafe(F.col("of")), small(rates)
    if fit is rates:
        fit = rates.withColumn("there", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same &= F.pmod("draw", F.lit(SALTS)) == F.col("there")
    copies = F.col("whole") + F.when(F.col("draw") < F.col("cutoff"), 1).otherwise(0)
    return own.join(fit, same).select("row.*", F.struct("size", "source_size", "target", copies.cast("int").alias("copies")).alias(out))


def emit(docs: DataFrame, **kind) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it."""
    name, copy = fresh(docs, "mix", "copy")
    taken = mix(docs, out=name, **kind).filter(F.col(f"{name}.copies") > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))).drop(name, copy)


#: DuckDB: the water-filling by cumulative sums over one row a source, and the draws from sha256.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(sha256('mix-1:' || coalesce(doc_id::VARCHAR, '~' || coalesce(text, ''))), 1, 3))::INTEGER AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s),
c AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER b, 0))::DOUBLE / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0))::DOUBLE AS share
      FROM r WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(share) AS level FROM c),
t AS (SELECT source, source_size, round(least(cap::DOUBLE, level * w), 6) AS target FROM c, l),
k AS (SELECT *, floor(CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END)::INTEGER AS whole FROM t),
u AS (SELECT source, -1 AS draw, 0::BIGINT AS words FROM s
      UNION ALL SELECT source, draw, sum(words) OVER (PARTITION BY source ORDER BY draw) FROM (SELECT source, draw, sum(size)::BIGINT AS words FROM d GROUP BY ALL)),
n AS (SELECT k.source, CASE WHEN any_value(whole) >= 3 THEN 0 ELSE arg_min(draw + 1, (abs(words - (target - whole * source_size)), draw)) END AS cutoff
      FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source GROUP BY k.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN draw < cutoff THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN n ON d.source IS NOT DISTINCT FROM n.source
"""
