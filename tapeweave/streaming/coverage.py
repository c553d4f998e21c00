"""Late and unreadable rows told apart instead of dropped, and windows that say what they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARK = "high timestamp"


def marked(folder: str, late: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each batch to `folder`/rows with a coverage column: on_time; late, if the time lies more than
    the lateness before the latest time of earlier batches; unreadable, without a time. The latest time so far is kept by
    batch beside them, so that a batch that runs again after a failure overwrites its own rows and marks them alike."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = spark.read.schema(f"{MARK}, batch long").parquet(f"{folder}/marks").where(F.col("batch") < number)
        high = earlier.agg(F.max("high").alias("high")).first().high  # one value
        bound = F.lit(high).cast("timestamp") - F.expr(f"interval {late}")
        coverage = F.when(F.col("time").isNull(), "unreadable").when(F.col("time") < bound, "late").otherwise("on_time")
        target = f"{folder}/rows/batch={number}"
        batch.withColumn("coverage", coverage).write.mode("overwrite").parquet(target)
        now = spark.read.parquet(target).agg(F.greatest(F.max("time"), F.lit(high).cast("timestamp")).alias("high"))
        now.write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    return write


def run(spark: SparkSession, schema: StructType, tape: str, folder: str, late: str) -> None:
    """Runs a stream over the files below `tape` that haven't been read, from where the last run ended."""
    spark.createDataFrame([(None,)], MARK).write.mode("ignore").parquet(f"{folder}/marks/batch=-1")
    stream = spark.readStream.schema(schema).option("basePath", tape).parquet(f"{tape}/*")
    writer = stream.writeStream.foreachBatch(marked(folder, late)).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()


def covered(rows: DataFrame, high: DataFrame, by: str, width: int, late: str) -> DataFrame:
    """by, start (a window's, in seconds), rows on time and late, and coverage: censored, if the window isn't over by the
    latest time less the lateness; late, if rows came late; else complete. Rows without a time are in no window."""
    start = F.floor(F.unix_seconds("time") / width) * width
    sums = rows.where(F.col("time").isNotNull()).groupBy(by, start.alias("start")).agg(F.count_if(F.col("coverage") == "on_time").alias("on_time"), F.count_if(F.col("coverage") == "late").alias("late"))
    end = high.agg(F.unix_seconds(F.max("high") - F.expr(f"interval {late}")).alias("end"))
    status = F.when(F.col("start") + width > F.col("end"), "censored").when(F.col("late") > 0, "late").otherwise("complete")
    return sums.crossJoin(F.broadcast(end)).select(by, "start", "on_time", "late", status.alias("coverage"))  # one row
