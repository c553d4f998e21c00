"""Bounded tables run through streams, slice by slice, each run going on from the checkpoint of the one before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def closing(rows: DataFrame, late: str, last: dict[str, Column] | None = None, beyond: str = "1 day") -> DataFrame:
    """One row later than all others by more than the lateness allowed and `beyond`, so that all are passed; its other columns are null
    but for aggregates of the rows given as `last`: a stream whose plan filters nulls needs values there."""
    after = (F.max("time") + F.expr(f"interval {late}") + F.expr(f"interval {beyond}")).alias("time")
    found = rows.agg(after, *((last or {}).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "time"))
    return found.where("time is not null").select(*rows.columns)


def land(rows: DataFrame, folder: str, number: int) -> None:
    """Adds a slice of a tape to the folder that a stream watches."""
    rows.write.parquet(f"{folder}/tape/slice={number}")


def run(spark: SparkSession, schema, build: Callable[[DataFrame], DataFrame], folder: str) -> None:
    """Runs a stream over what has landed and hasn't been read, from where the last run ended, and ends."""
    out = build(spark.readStream.schema(schema).option("basePath", f"{folder}/tape").parquet(f"{folder}/tape/*"))
    with rocks_db(spark):
        writer = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def replayed(rows: DataFrame, slices: list, build: Callable[[DataFrame], DataFrame], folder: str, late: str, last: dict[str, Column] | None = None, beyond: str = "1 day") -> DataFrame:
    """What a stream writes of rows that land in slices (conditions on the rows), one run each, and of a closing row
    (see `closing`) in a last run; beyond is as long as the stream waits besides the lateness, such as the interval of a
    join. rows have a time; build makes the stream; the folder is new and shared by driver and executors."""
    spark = rows.sparkSession
    for number, condition in enumerate(slices):
        land(rows.where(condition), folder, number)
        run(spark, rows.schema, build, folder)
    land(closing(rows, late, last, beyond), folder, len(slices))
    run(spark, rows.schema, build, folder)
    return spark.read.parquet(f"{folder}/out")
