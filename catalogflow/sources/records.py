"""Fixed-width and block text: located summaries, relocation tables, station cards, phase files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import schemas


def number(column: Column, kind: str = "double") -> Column:
    """A number, or null for blanks, stars of an overflow and anything else."""
    return F.trim(column).try_cast(kind)


def fixed(lines: DataFrame, fields: Sequence[tuple[str, int, int, str]], column: str = "value") -> DataFrame:
    """Columns (name, first character from 1, length, type) of fixed-width lines."""
    return lines.select(*[(number(F.substring(column, at, n), kind) if kind != "string" else F.trim(F.substring(column, at, n))).alias(name) for name, at, n, kind in fields])


#: Fixed layout of a summary line.
SUMMARY = (
    ("year", 1, 4, "int"), ("month", 5, 2, "int"), ("day", 7, 2, "int"), ("hour", 10, 2, "int"), ("minute", 12, 2, "int"), ("second", 15, 5, "double"), ("lat", 21, 8, "double"), ("lon", 30, 9, "double"), ("depth", 40, 6, "double"),
    ("num", 47, 3, "int"), ("gap", 51, 3, "double"), ("rms", 55, 5, "double"), ("erh", 61, 5, "double"), ("erz", 67, 5, "double"), ("qual", 73, 1, "string"),
)


def read_summary(lines: DataFrame) -> DataFrame:
    """Located events of summary lines; overflowed or blank numbers are null."""
    f = fixed(lines, SUMMARY)
    at = F.try_make_timestamp(F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.col("minute"), F.col("second").cast("decimal(8,6)"))
    return f.select(at.alias("time"), "lat", "lon", "depth", "num", "gap", "rms", "erh", "erz", "qual")


def read_columns(lines: DataFrame, names: Sequence[str], column: str = "value") -> DataFrame:
    """Numeric columns of lines split at blanks; lines with fewer fields are left out."""
    parts = lines.select(F.split(F.trim(column), r"\s+").alias("p")).filter(F.size("p") >= len(names))
    return parts.select(*[F.col("p")[i].try_cast("double").alias(n) for i, n in enumerate(names)])


def read_relocated(lines: DataFrame) -> DataFrame:
    """The 24-column relocation table with its time; seconds stop at 59.999."""
    f = read_columns(lines, schemas.RELOCATED)
    whole = ("id", "yr", "mo", "dy", "hr", "mi", "nccp", "nccs", "nctp", "ncts", "cid")
    f = f.withColumns({c: F.col(c).cast("long" if c == "id" else "int") for c in whole})
    return f.withColumn("time", F.make_timestamp("yr", "mo", "dy", "hr", "mi", F.least("sc", F.lit(59.999)).cast("decimal(8,6)"))).withColumn("linked", F.col("nccp") + F.col("nccs") > 0)


def blocks(lines: DataFrame, *, number: str, value: str, starts: Column) -> DataFrame:
    """``block``: how many header lines there are up to each line of a file (column ``path``)."""
    w = Window.partitionBy("path").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def read_covariances(lines: DataFrame, *, mark: str = "COVARIANCE", width: int = 8, rows: int = 3) -> DataFrame:
    """path, block and the entries c11, c12, ... of each covariance block: a line with ``mark``, then ``rows``
    lines of numbers of ``width`` characters each that may stand glued; a number that does not parse is null.
    Lines are (path, n, value); those of other kinds are passed over."""
    own = blocks(lines, number="n", value="value", starts=F.col("value").contains(mark)).filter("block > 0")
    at = Window.partitionBy("path", "block").orderBy("n")
    body = own.withColumn("__k", F.row_number().over(at) - 1).filter(F.col("__k").between(1, rows))
    cell = lambda j: number(F.substring("value", 1 + j * width, width))
    return body.groupBy("path", "block").agg(*(F.max(F.when(F.col("__k") == i, cell(j - 1))).alias(f"c{i}{j}") for i in range(1, rows + 1) for j in range(1, rows + 1)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n (ascending within a file, not without gaps) and value of the lines of text files. Files split:
    n is the byte block that a line stands in and its place there, so no file has to fit a task."""
    at = F.monotonically_increasing_id()
    own = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("__start"), "value", at.alias("__at"))
    within = F.row_number().over(Window.partitionBy("path", "__start").orderBy("__at"))
    return own.select("path", (F.col("__start") * 1024 + within).alias("n"), "value")


def subset_blocks(lines: DataFrame, keep: DataFrame, *, id: str = "id") -> DataFrame:
    """The lines, unchanged, of blocks whose id is kept."""
    return lines.join(keep.select(id).distinct(), id, "left_semi")


def renumber_blocks(lines: DataFrame, ids: DataFrame, *, at: int, width: int, id: str = "id", new: str = "new_id") -> DataFrame:
    """The lines of kept blocks with the new id written over the old one's columns."""
    return lines.join(ids, id).withColumn("value", F.overlay("value", F.lpad(F.col(new).cast("string"), width, " "), F.lit(at), F.lit(width)))


def phase_lines(picks: DataFrame, *, event: str = "event_idx") -> DataFrame:
    """One text block an event: its phases by time, P as IP on the vertical, S as ES on the north."""
    line = F.concat(F.rpad("station", 5, " "), F.when(F.col("phase") == "P", "HHZ IP").otherwise("HHN ES"), F.col("weight").cast("string"), F.lit(" "), F.date_format("time", "yyMMddHHmmss.SS"))
    by = picks.withColumn("__l", F.struct("time", "station", "phase", line.alias("text"))).groupBy(event).agg(F.array_sort(F.collect_list("__l")).alias("l"), F.count("*").alias("n"))
    return by.select(event, "n", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("block"))
