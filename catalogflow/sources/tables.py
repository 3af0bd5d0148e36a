"""CSV, Parquet, JSON and XML sources, and sinks that never overwrite what they read."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import windows as wn
from . import schemas


def without_nan(frame: DataFrame) -> DataFrame:
    """NaN becomes null: in comparisons a NaN would pass as larger than any number."""
    kinds = (T.DoubleType, T.FloatType)
    return frame.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in frame.schema if isinstance(f.dataType, kinds)})


def reconciled(frame: DataFrame, more: Mapping[str, str] = {}) -> DataFrame:
    """Older column names become the schema's, unless the schema's name is there already."""
    names = {a: b for a, b in {**schemas.ALIASES, **more}.items() if a in frame.columns and b not in frame.columns}
    return frame.withColumnsRenamed(names)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(where)
    return found is not None and len(found) > 0


def read_picks(spark: SparkSession, folder: str, year: int, day: int | None = None) -> DataFrame:
    """Daily pick files ``picks_<year>.<doy>.csv``: of a year (an error if there are none), or of one
    day (no rows if its file is missing). Times are UTC; ``net`` and ``code`` are split off."""
    path = f"{folder}/picks_{year}.{'*' if day is None else f'{day:03d}'}.csv"
    if not _there(spark, path):
        if day is None:
            raise FileNotFoundError(path)
        frame = spark.createDataFrame([], schemas.PICKS)
    else:
        frame = spark.read.schema(schemas.PICKS).option("header", True).csv(path)
    return without_nan(frame).withColumn("net", text.network(F.col("station"))).withColumn("code", text.code(F.col("station")))


def read_year(spark: SparkSession, folder: str, year: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Events and assignments of a year, or two Nones if either file is missing. Stations lose their
    final dot, unix seconds become timestamps."""
    paths = [f"{folder}/{kind}_{year}.csv" for kind in ("events", "assignments")]
    if not all(_there(spark, p) for p in paths):
        return None, None
    events = reconciled(spark.read.schema(schemas.EVENTS).option("header", True).csv(paths[0]))
    found = spark.read.schema(schemas.ASSIGNMENTS).option("header", True).csv(paths[1])
    found = found.withColumn("station", text.without_dot(F.col("station"))).withColumn("pick_time", F.timestamp_micros((F.col("time") * 1_000_000).cast("long")))
    return without_nan(events), without_nan(found)


class Cached:
    """Reads by key through ``load``, the last ``most`` of them kept persisted; older ones are let go."""

    def __init__(self, load: Callable[..., DataFrame], most: int = 64) -> None:
        self.load, self.most, self.kept = load, most, OrderedDict()

    def __call__(self, *key) -> DataFrame:
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            self.kept[key] = self.load(*key).persist()
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)[1].unpersist()
        return self.kept[key]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV catalog (time, and any others) with event_key: the second's stamp, b, c, ... for later events
    of the same second, by time and then place in the row. Rows without a time are left out."""
    frame = reconciled(spark.read.option("header", True).option("inferSchema", True).csv(path))
    frame = without_nan(frame.withColumn("time", F.to_timestamp("time")).filter("time IS NOT NULL"))
    order = F.xxhash64(*frame.columns)
    return wn.same_second_ids(frame.withColumn("__o", order), at="time", id="__o", stamp=F.date_format("time", "yyyyMMddHHmmss")).drop("__o")


def of_year_or_before(tables: DataFrame, year: int, column: str = "year") -> DataFrame:
    """Rows of the latest year that is not after the wanted one."""
    best = tables.filter(F.col(column) <= year).agg(F.max(column)).first()[0]
    return tables.filter(F.col(column) == F.lit(best))


def of_clamped_year(tables: DataFrame, year: int, column: str = "year") -> DataFrame:
    """Rows of the wanted year, moved into the range of years there are."""
    low, high = tables.agg(F.min(column), F.max(column)).first()
    return tables.filter(F.col(column) == F.lit(None if low is None else max(low, min(high, year))))


def read_stations(spark: SparkSession, path: str, **constant) -> DataFrame:
    """A CSV station list with constant columns added, each station once."""
    frame = spark.read.schema(schemas.STATIONS).option("header", True).csv(path)
    return frame.withColumns({k: F.lit(v) for k, v in constant.items()}).dropDuplicates(["Network", "Code"])


def read_epochs(spark: SparkSession, path: str, *, net: str) -> DataFrame:
    """A CSV list of station epochs (code, latitude, longitude, elevation, start, end): one row an epoch,
    with the letter of its place among the code's epochs and t1 where the next one starts."""
    frame = spark.read.schema("code string, latitude double, longitude double, elevation double, start timestamp, end timestamp").option("header", True).csv(path)
    return wn.with_epochs(frame.dropDuplicates(["code", "start"]), key="code", start="start", end="end").withColumn("net", F.lit(net))


def read_station_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row a (net, sta): place, bands (sorted, slash-joined), first start and last end. Epochs come
    from velocity channels (band code ending in H) where there are any, else from all."""
    channel = "struct<_code:string,_startDate:string,_endDate:string>"
    schema = f"_code string, Station array<struct<_code:string,Latitude:double,Longitude:double,Elevation:double,Channel:array<{channel}>>>"
    nets = spark.read.format("xml").option("rowTag", "Network").schema(schema).load(path)
    sta = nets.select(F.col("_code").alias("net"), F.explode("Station").alias("s"))
    ch = sta.select("net", F.col("s._code").alias("sta"), F.col("s.Latitude").alias("lat"), F.col("s.Longitude").alias("lon"), F.col("s.Elevation").alias("elev"), F.explode_outer("s.Channel").alias("c"))
    ch = ch.select("net", "sta", "lat", "lon", "elev", F.substring("c._code", 1, 2).alias("band"), F.to_timestamp("c._startDate").alias("t0"), F.to_timestamp("c._endDate").alias("t1"))
    velocity = F.col("band").endswith("H")
    return ch.groupBy("net", "sta").agg(
        F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("elev").alias("elev"), F.concat_ws("/", F.array_sort(F.collect_set("band"))).alias("bands"),
        F.coalesce(F.min(F.when(velocity, F.col("t0"))), F.min("t0")).alias("t0"), F.coalesce(F.max(F.when(velocity, F.col("t1"))), F.max("t1")).alias("t1"),
    )


def read_breaks(spark: SparkSession, path: str) -> DataFrame:
    """key, breaks (sorted dates) of a JSON object {key: [date, ...]}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<date>>").alias("m"))
    return raw.select(F.explode("m").alias("key", "breaks")).withColumn("breaks", F.array_sort("breaks"))


def archive_days(files: DataFrame) -> DataFrame:
    """net-less (sta, band, year, days) of a listing of paths ``.../<sta>/<band>?.D/*.<year>.<doy>``: the
    channel with the most days stands for its band."""
    parts = files.select(F.regexp_extract("path", r"([^/]+)/([^/]+)\.D/[^/]*\.(\d{4})\.(\d{3})$", 1).alias("sta"), F.regexp_extract("path", r"([^/]+)/([^/]+)\.D/[^/]*\.(\d{4})\.(\d{3})$", 2).alias("channel"), F.regexp_extract("path", r"\.(\d{4})\.(\d{3})$", 1).alias("year"), F.regexp_extract("path", r"\.(\d{4})\.(\d{3})$", 2).alias("doy")).filter("sta <> ''")
    by = parts.groupBy("sta", F.substring("channel", 1, 2).alias("band"), "channel", F.col("year").cast("int").alias("year")).agg(F.count_distinct("doy").alias("days"))
    return by.groupBy("sta", "band", "year").agg(F.max("days").alias("days"))


def coverage(files: DataFrame, *, year: int, first: int, last: int) -> DataFrame:
    """sta, band, days and coverage (days / length) within the days ``first`` to ``last`` of a year."""
    at = r"([^/]+)/([^/]+)\.D/[^/]*\.(\d{4})\.(\d{3})$"
    part = lambda k: F.regexp_extract("path", at, k)
    own = files.select(part(1).alias("sta"), F.substring(part(2), 1, 2).alias("band"), part(3).alias("year"), part(4).try_cast("int").alias("doy"))
    inside = own.filter((F.col("sta") != "") & (F.col("year") == str(year)) & F.col("doy").between(first, last))
    return inside.groupBy("sta", "band").agg(F.count_distinct("doy").alias("days")).withColumn("coverage", F.col("days") / (last - first + 1))


def write_parquet(frame: DataFrame, path: str, about: Mapping[str, str] | None = None, partition: Sequence[str] = ()) -> None:
    """Parquet, with the run's facts as one JSON line in ``<path>.meta``."""
    frame.write.mode("errorifexists").partitionBy(*partition).parquet(path)
    if about is not None:
        spark = frame.sparkSession
        spark.createDataFrame([(k, str(v)) for k, v in sorted(about.items())], "key string, value string").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("value")).write.text(f"{path}.meta")


def replace_csv(frame: DataFrame, path: str) -> str:
    """Write a new version of a CSV folder beside the old one, then swap; the old one stays as a backup
    whose path is returned ('' if there was none). The frame may read the old version."""
    spark = frame.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.bak-{uuid.uuid4().hex[:8]}"
    frame.write.option("header", True).csv(new)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(p(path))
    if had:
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    return old if had else ""
