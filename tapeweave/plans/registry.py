"""Where queries and, if SQL can express them, their SQL are registered by name."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Without one: a temporary one in local mode, as in tests; on a cluster
    there is none that all executors share, which is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tapeweave-"))
    return named or context.getCheckpointDir()
