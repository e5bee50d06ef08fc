"""Arrow maps for functions that read one value at a time, and null-safe scalar UDF wrappers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def explode_rows(df: DataFrame, schema: str, one: Callable[..., list[tuple]], slice_rows: int = 256) -> DataFrame:
    """Narrow map: ``one(*values of a row)`` gives the rows that stand for it."""
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                columns = [c.to_pylist() for c in batch.slice(at, slice_rows).columns]
                rows = [r for values in zip(*columns) for r in one(*values)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def scalar(fn: Callable, returns: str) -> Callable[..., Column]:
    """An Arrow-batched Column function from a plain one; a null in the first argument gives null."""

    def wrapped(*columns) -> Column:
        @F.udf(returnType=returns, useArrow=True)
        def call(*values):
            return None if values[0] is None else fn(*values)

        return call(*columns)

    wrapped.__name__ = getattr(fn, "__name__", "scalar")
    wrapped.__doc__ = fn.__doc__
    return wrapped


def series(fn: Callable, returns: str) -> Callable[..., Column]:
    """Like ``scalar`` for string or number results, as a pandas UDF over one column."""

    def call(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fn(v))

    return F.pandas_udf(call, returns)
