"""Helpers that the corpus operators share: staging, Arrow rows, an id filter of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import run_dir

# Bits of an id filter: 4 MB to send, whatever the number of ids. With more
# ids than it can tell apart it lets more rows through, never fewer.
FILTER_BITS = 1 << 25
FILTER_HASHES = 3
# Text that a task works on at once, in bytes.
CHUNK_BYTES = 1 << 19


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder in the shared space and read it back: it is
    computed once, and a lost executor loses nothing of it."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def set_apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with every column under a name that no operator uses, and those names by the columns' own."""
    names = {c: f"_own{i}" for i, c in enumerate(df.columns)}
    return df.select(*[quoted(c).alias(n) for c, n in names.items()]), names


def brought_back(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """The columns of ``set_apart`` under their own names, and ``more`` of ``df``."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()], *more)


def id_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """A key that is never null: the id, or for a null id a negative hash of the text."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    return F.coalesce(quoted(id_col).cast("long"), -1 - F.pmod(F.xxhash64(text), F.lit(1 << 62)))


def chunks(texts: list[str | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``size`` characters; one text is never split."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_slices(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch with their texts, so that a task holds few texts as Python values at a time."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        texts = part.column(column).to_pylist()
        for start, stop in chunks(texts, size):
            yield part.slice(start, stop - start), texts[start:stop]


def added(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _positions(column: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(column, F.lit(i)), F.lit(bits)) for i in range(FILTER_HASHES)]


def id_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS):
    """A test, as a function of a column, that is true for every id of ``ids``
    and for few others. What comes to the driver is at most ``bits`` bits."""
    spark = ids.sparkSession
    at = ids.select(F.explode(F.array(*_positions(quoted(column), bits))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")
    )
    table = np.zeros(bits // 64, np.int64)
    # Of fixed size, so one task may hand it over; else each partition would be a job.
    for word, value in words.repartition(1).toLocalIterator():
        table[word] = value
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def listed(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        held = shared.value
        found = np.ones(len(a), bool)
        for position in (a.to_numpy(), b.to_numpy(), c.to_numpy()):
            found &= (held[position >> 6] >> (position & 63)) & 1 == 1
        return pd.Series(found)

    return lambda key: listed(*_positions(key, bits))
