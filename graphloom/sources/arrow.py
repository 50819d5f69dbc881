"""Results as Arrow record batches of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 8192


def record_batches(df: DataFrame, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, fetched partition by partition: the driver never holds the whole result."""
    schema = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in df.schema]) if all(_arrow(t) is not None for _, t in df.dtypes) else None
    if schema is None:
        yield from df.toArrow().to_batches(max_chunksize=rows)
        return
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        if len(held) == rows:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(t: str) -> pa.DataType | None:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}.get(t)
