"""Streaming ingest of a trace: a file source, drained and then stopped."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.store import new_folder


def drained(spark: SparkSession, path: str, pids, schema: str, files_a_batch: int | None = None) -> DataFrame:
    """What a stateful stream over the Parquet files of a folder gives once all that was there is read.

    ``pids`` turns the stream into rows; the stream ends by itself, and only
    then its output is read, so that nothing seen before the end is missed.
    ``files_a_batch`` bounds a batch; files come in the order of their times.
    """
    folder = new_folder(spark, "stream")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet")
    rows = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)
    run = pids(rows).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def late(seen: DataFrame, process: DataFrame) -> DataFrame:
    """Names and directories of the processes seen, looked up once the stream has ended; unknown ones are empty."""
    return seen.join(process, "pid", "left").select("pid", F.coalesce(F.trim("comm"), F.lit("")).alias("comm"), "cwd")
