"""All registered queries of the library."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from . import queries_extra, queries_instruments, queries_joins, queries_more, queries_stats  # noqa: F401
from .registry import ORACLES, QUERIES


def prepare(spark: SparkSession) -> None:
    """A checkpoint folder for the iterative operators: the one that spark.checkpoint.dir names; where
    that is unset, as in a local session, a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="catalogflow-"))


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
