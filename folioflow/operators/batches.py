"""Runs Python over Arrow batches where columns can't express an operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, fn: Callable[[dict], Iterator[tuple]], schema: StructType, rows: int = 1000, before: Callable[[list[dict]], None] | None = None) -> DataFrame:
    """``fn`` gets a row as a dict and yields output tuples in the order of ``schema``; ``before`` may add to the rows of a batch at once."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows).to_pylist()
                if before:
                    before(part)
                out = [t for row in part for t in fn(row)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
