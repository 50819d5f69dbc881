"""Cutting lineage in iterative algorithms."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that a partition of a shuffle should have at most.
PARTITION_ROWS, PARTITION_BYTES = 500_000, 8 << 20


@contextmanager
def bounded(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside shuffles a table of that many rows into partitions whose size doesn't grow with it: more of them, not joined to large ones."""
    parts, most = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = {key: spark.conf.get(key) for key in (parts, most)}
    spark.conf.set(parts, str(max(int(old[parts]), -(-rows // PARTITION_ROWS))))
    spark.conf.set(most, str(min(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(old[most]), PARTITION_BYTES)))
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the folder the cluster shares and read it back: lineage ends, lost executors don't matter."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:  # no cluster named one: tests and single machines
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
