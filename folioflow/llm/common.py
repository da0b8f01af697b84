"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written  # noqa: F401 - for the operators
from ..sources.tables import read_table as table  # noqa: F401 - for the queries

#: Spark DDL types to Arrow types, for the few types the operators emit.
_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    fields = [part.strip().split(" ", 1) for part in ddl.split(",")]
    return pa.schema([(name, _ARROW[kind.strip()]) for name, kind in fields])


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    ddl: str,
    batch_rows: int = 2000,
) -> DataFrame:
    """Runs a batch function over Arrow batches.

    ``make`` is called once in each task and returns a function from columns
    (name to list) to output columns. Batches are cut to ``batch_rows`` rows so
    that a task's memory doesn't follow the session's batch size.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                columns = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                out = fn(columns)
                if out and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], type=f.type) for f in schema], schema=schema
                    )

    return df.mapInArrow(run, ddl)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


# ---- filters by hash ------------------------------------------------------

#: Bounds of a bitmap, as powers of two; between them it has 16 bits for each hash.
LEAST_BITS, FILTER_BITS = 20, 28


class Filter:
    """A bitmap of the leading bits of hashes: what does not pass isn't in the set."""

    def __init__(self, bits: int, data: bytes):
        self.shift = np.uint64(64 - bits)
        self.map = np.frombuffer(data, np.uint8)

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Where the hashes are that may be in the set."""
        at = h >> self.shift
        return np.flatnonzero(self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


def bitmap(hashes: DataFrame, n: int) -> tuple[int, Broadcast]:
    """The bitmap of a column ``hash`` of about ``n`` rows: made in the JVM in parts of 4 kB, of which the driver gets at most 2 ** FILTER_BITS bits."""
    bits = min(FILTER_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    x = F.shiftrightunsigned("hash", 64 - bits) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(x).alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("part")).collect()
    out = bytearray(1 << (bits - 3))
    for r in parts:
        at = (r.no - 1) * len(r.part)
        out[at : at + len(r.part)] = r.part
    return bits, hashes.sparkSession.sparkContext.broadcast(bytes(out))
