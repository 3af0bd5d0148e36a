"""Tables between the rounds of iterative operators, as files in the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(frame: DataFrame) -> DataFrame:
    """``frame`` written as Parquet into the folder of checkpoints and read back.

    Unlike a checkpoint it forgets the plan's estimated size too, which doubles its digits with every join of a
    loop. The folder goes with :func:`dropped`, at the latest when the driver ends.
    """
    spark = frame.sparkSession
    place = spark.sparkContext._jsc.sc().getCheckpointDir()
    if place.isEmpty():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{place.get()}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    where, files = _folder(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(frame.schema).parquet(path)
    out._written = path
    return out


def _folder(spark, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(*frames: DataFrame) -> None:
    """Delete the files of tables that :func:`written` gave and that nothing reads any more."""
    for frame in frames:
        where, files = _folder(frame.sparkSession, frame._written)
        files.delete(where, True)
