"""Tables in the folder that all executors share: lineage ends there, and what several plans read is made once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which Spark may broadcast a table, and the least that a row takes there for each column and once more.
BROADCAST_BYTES, ROW_BYTES = 10 << 20, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where none is set and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/loomgraph-checkpoints"
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back; the files go when the driver's JVM ends.

    A table whose rows take more than BROADCAST_BYTES is joined by sorting, however small its files are, so that the driver does
    not collect it for a broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    # Spark takes a file's size for the table's, and columns of keys shrink fifty times and more in a file; the count reads footers
    return held.hint("shuffle_merge") if held.count() * ROW_BYTES * (1 + len(df.columns)) > BROADCAST_BYTES else held
