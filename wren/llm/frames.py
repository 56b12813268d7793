"""Small helpers shared by the operators: fresh column names, slices of Arrow
batches, and a size check in front of a broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of text that a task holds as Python objects at a time.
SLICE_ROWS = 256


def fresh(base: str, taken: list[str]) -> str:
    """A column name that no column of ``taken`` has."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when it has at most ``max_rows`` rows; beyond that Spark joins by shuffle.

    Reads at most ``max_rows + 1`` rows of the (aggregated) side to find out.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def map_text(df: DataFrame, text_col: str, fn: Callable[[list], list[dict]], added: T.StructType) -> DataFrame:
    """Add columns computed from whole texts by a Python function, row for row.

    ``fn`` gets a list of texts (None for null) and returns one dict per text.
    All columns of ``df`` are kept except those whose names clash with
    ``added``; they pass through Arrow untouched.
    """
    names = [f.name for f in added.fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    carry = fresh("text_in", df.columns + names)
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").alias(carry))
    schema = T.StructType([*kept, *added.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    n_kept, rows = len(kept), SLICE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, rows):
                b = big.slice(at, rows)
                out = fn(b.column(n_kept).to_pylist())
                cols = [b.column(i).cast(arrow.field(i).type) for i in range(n_kept)]
                cols += [pa.array([r[n] for r in out], type=arrow.field(n_kept + k).type) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return source.mapInArrow(run, schema)
