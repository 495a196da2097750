"""Small helpers for functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows of one step inside a task; long texts make Spark's own batches large, so they are sliced.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes; nulls as empty ones."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def map_slices(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, object]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow where `make` turns a slice into columns (lists or arrays) of the result."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(wanted)
        for batch in slices(batches):
            made = make(batch)
            columns = [made[f.name] for f in target]
            columns = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, target)]
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, wanted)
