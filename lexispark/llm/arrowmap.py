"""Arrow-batch maps that keep whole rows or replace them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm import textvec as tv


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def freeing(run: Callable) -> Callable:
    """run, after each partition of which freed memory goes back: a worker is kept for later tasks, beside others and the JVM."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return freed


def annotate(df: DataFrame, text_col: str, fields: str, compute: Callable) -> DataFrame:
    """Columns row (struct of all columns of df, whatever their names) and result.

    compute(text column without nulls, validity as numpy) -> list of Arrow arrays for
    `fields` (a DDL string), one row each. Called on slices of bounded size.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    result = T.StructType.fromDDL(fields)
    schema = T.StructType([T.StructField("row", df.select(F.struct("*").alias("row")).schema["row"].dataType), T.StructField("result", result)])
    place = df.columns.index(text_col)
    names = [f.name for f in result]
    kinds = [to_arrow_type(f.dataType) for f in result]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).field(place)
            valid = column.is_valid()
            for part, text in tv.row_slices(batch, tv.filled(column)):
                at = text.offset - tv.filled(column).offset
                ok = valid.slice(at, len(text)).to_numpy(zero_copy_only=False)
                arrays = [pa.array(a, k) if not isinstance(a, pa.Array) else a.cast(k) for a, k in zip(compute(text, ok), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.StructArray.from_arrays(arrays, names)], ["row", "result"])

    return df.select(F.struct("*").alias("row")).mapInArrow(freeing(run), schema)


def over_texts(df: DataFrame, id_col: str, text_col: str, schema: str, emit: Callable) -> DataFrame:
    """emit(ids, text column without nulls) -> dict of arrays (any number of rows) or None, for slices of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in tv.row_slices(batch, tv.filled(batch.column(1))):
                made = emit(part.column(0), text)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(freeing(run), out)
