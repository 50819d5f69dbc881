"""Helpers shared by the training-data operators.

Intermediate tables that several jobs read are written to the folder the
cluster shares (``spark.checkpoint.dir``), never to a machine-local path, so a
lost executor costs a re-read and not a recomputation from the start.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, rows: int = 500, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows and bytes of text, one row at least: what Python holds at once is bounded by them, whatever the session's batches are."""
    for batch in batches:
        text = batch.column(column).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: texts may be long, and the default is 10,000 rows a batch."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, label: str, partitions: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: this cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete the files of tables made by written() that nothing lazy needs any more.

    Then the JVM is asked to collect: only that lets Spark drop the shuffle files of
    finished jobs, which would otherwise pile up over a loop of batches.
    """
    for df in tables:
        for name in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            while "/graphloom-" in name and not name.rsplit("/", 1)[1].startswith("graphloom-"):
                name = name.rsplit("/", 1)[0]
            if "/graphloom-" in name:
                delete(df.sparkSession, name)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


MAP_BITS = 27


def bitmap_position(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - MAP_BITS)


def bitmap(positions: DataFrame) -> bytes:
    """2**MAP_BITS bits (16 MB, the same at any size), those at column ``p`` set."""
    p = F.col("p") + 1
    rows = positions.groupBy(F.bitmap_bucket_number(p).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("m")).collect()
    whole = bytearray(1 << (MAP_BITS - 3))
    for row in rows:
        at = (row["b"] - 1) * 4096
        whole[at : at + 4096] = row["m"]
    return bytes(whole)


def hit_rows(df: DataFrame, column: str, ids: DataFrame, invert: bool = False) -> DataFrame:
    """Rows of df whose long ``column`` may be among ids: all that are, and few others; invert: the rows that surely aren't.

    A fixed bitmap of hashes is what is broadcast, and only hashes go to Python, so most
    rows need no shuffle; a join decides on what is left.  A null is never hit.
    """
    shared = df.sparkSession.sparkContext.broadcast(bitmap(ids.filter(F.col(column).isNotNull()).select(bitmap_position(F.xxhash64(column)).alias("p"))))

    @F.pandas_udf("boolean")
    def may(positions: pd.Series) -> pd.Series:
        bits = np.frombuffer(shared.value, np.uint8)
        p = positions.to_numpy()
        return pd.Series((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    hit = F.col(column).isNotNull() & may(bitmap_position(F.xxhash64(F.col(column).cast("long"))))
    return df.filter(~hit if invert else hit)


def sum_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body(value), with value computed once; a column named in a lambda may be inlined and computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def prefix_sums(steps: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array<long>, in blocks: n * block steps rather than n * n.

    An empty array gives an empty array.
    """
    totals = lambda s: F.transform(F.sequence(F.lit(0), ((F.size(s) - 1) / block).cast("int")), lambda b: sum_of(F.slice(s, b * block + 1, F.lit(block))))
    before = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda b: sum_of(F.slice(t, F.lit(1), b)))
    inner = lambda s, pre: F.transform(s, lambda x, i: F.get(pre, (i / block).cast("int")) + sum_of(F.slice(s, (i / block).cast("int") * block + 1, i % block)))
    whole = let(steps, lambda s: let(totals(s), lambda t: let(before(t), lambda pre: inner(s, pre))))
    return F.when(F.size(steps) > 0, whole).otherwise(F.array().cast("array<long>"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds = fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
