"""Rows of a key together, many keys at a time, in the Arrow batches of a task: for keys of few rows, which numpy then takes in one go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

KINDS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def known(key: T.DataType) -> bool:
    """Whether Arrow tells keys of this type apart as Spark does."""
    return isinstance(key, KINDS) or key == T.StringType()


def one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def begins(key: pa.ChunkedArray) -> np.ndarray:
    """Where keys begin, of rows in the order of a key without nulls."""
    k = one(key)
    return np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False))]).astype(np.int64)


def groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that hold keys whole; rows come in the order of the key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(begins(t.column(key))[-1])  # the last key may go on
            if cut:
                yield t.slice(0, cut)
            held = pa.Table.from_arrays([pa.concat_arrays(c.chunks) for c in t.slice(cut).columns], schema=t.schema).to_batches()
            n -= cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
