"""A trace taken in by a stream that can be stopped, resumed and reported on at any time.

All that a run leaves lies in one folder: the checkpoint, the decoded events of
each batch and the counters observed while the batch was written, in one pass.
A batch that is run again after a failure overwrites its own folders, and its
events count only once its counters are there, so nothing is taken in twice or
in part.
"""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairn.sources import packages

#: Counters of a trace, in order.
COUNTERS = ("records", "short", "overlong", "invalid", "opens", "forks")


def counters(records: DataFrame) -> DataFrame:
    """``records`` (seq, record) with what the counters look at."""
    whole = F.length("record") >= packages.RECORD
    size = F.when(whole, packages.number("record", 5, 4))
    fork = packages.number("record", 9, 1) == packages.FORK
    name = F.expr(f"cast(substring(record, 13, cast(least(_size, {packages.NAME}) as int)) as string)")
    rows = records.withColumn("_size", size)
    return rows.select(
        "seq", "record", whole.alias("_whole"), (whole & fork).alias("_fork"),
        (whole & ~fork & (F.col("_size") > packages.NAME)).alias("_overlong"), (whole & ~fork & ~F.coalesce(F.is_valid_utf8(name), F.lit(True))).alias("_invalid"),
    )


def observed(records: DataFrame, observation: Observation | str) -> DataFrame:
    """``records`` whose counters are taken as they pass: short ones, opens whose name is over its length or no UTF-8, and the numbers seen."""
    some = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    values = {
        "records": F.count(F.lit(1)), "short": some(~F.col("_whole")), "overlong": some(F.col("_overlong")), "invalid": some(F.col("_invalid")),
        "opens": some(F.col("_whole") & ~F.col("_fork")), "forks": some(F.col("_fork")), "first": F.min("seq"), "last": F.max("seq"),
    }
    named: list[Column] = [v.alias(k) for k, v in values.items()]
    return counters(records).observe(observation, *named).select("seq", "record")


COUNTS = "batch long, records long, short long, overlong long, invalid long, opens long, forks long, first long, last long"


def taken_in(folder: str):
    """What is done with a batch."""

    def run(batch: DataFrame, number: int):
        spark, seen = batch.sparkSession, Observation()
        packages.events(observed(batch, seen)).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        counts = [(number, *(seen.get.get(c.split()[0]) for c in COUNTS.split(", ")[1:]))]
        spark.createDataFrame(counts, COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/{number}")

    return run


def advance(spark: SparkSession, trace: str, folder: str, files_a_batch: int = 1000) -> None:
    """Take in what has arrived in ``trace`` (Parquet of seq, record) since the last call with ``folder``, then stop."""
    rows = spark.readStream.schema("seq long, record binary").option("maxFilesPerTrigger", files_a_batch).parquet(trace)
    run = rows.writeStream.foreachBatch(taken_in(folder)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of all complete batches: one row each."""
    return spark.read.schema(COUNTS).parquet(f"{folder}/counts/*")


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded events of all complete batches so far."""
    rows = spark.read.schema("seq long, pid long, is_fork boolean, raw_path string, batch long").parquet(f"{folder}/events")
    return rows.join(counted(spark, folder).select("batch"), "batch", "left_semi").drop("batch")


def totals(counts: DataFrame) -> DataFrame:
    """One row: the sums of counters, and how many numbers between the first and the last never came (``dropped``)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    dropped = F.coalesce(F.max("last") - F.min("first") + 1 - F.sum("records"), F.lit(0)).alias("dropped")
    return counts.agg(*sums, dropped)
