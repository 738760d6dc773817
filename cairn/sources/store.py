"""Tables written to the folder that all executors share, where lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where Spark itself is one local process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str = "cairn") -> str:
    """A name in the shared folder that nothing has."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(rows: DataFrame, *partitioned_by: str) -> str:
    """The new folder in the shared one that ``rows`` were written to."""
    path = new_folder(rows.sparkSession)
    rows.write.parquet(path, partitionBy=list(partitioned_by) or None)
    return path


def stage(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read again."""
    return rows.sparkSession.read.schema(rows.schema).parquet(written(rows))
