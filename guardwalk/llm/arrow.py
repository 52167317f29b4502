"""Row-at-a-time work on Arrow batches: texts come in small slices, so memory stays bounded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 64


def ascii_lower(text: str) -> str:
    """A-Z in lower case, all else as it is: bytes.lower() leaves bytes of other characters alone."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def map_rows(df: DataFrame, columns: list[Column], schema: str, make: Callable[[], Callable[..., tuple]], rows: int = 2000) -> DataFrame:
    """One output row per input row: `make()` runs once per task and gives the function of `columns`."""
    names = [f"c{i}" for i in range(len(columns))]
    inner = df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])
    fields = [(f.name, f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([(n, to_arrow_type(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            made: list[tuple] = []
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                made += [f(*r) for r in zip(*[part.column(i).to_pylist() for i in range(part.num_columns)], strict=True)]
                if len(made) >= rows:
                    yield _batch(made, out)
                    made = []
            if made:
                yield _batch(made, out)

    return inner.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def map_groups(df: DataFrame, columns: list[Column], schema: str, make: Callable[[], Callable[[list[tuple]], list[tuple]]], weigh: int, limit: int = 1 << 20) -> DataFrame:
    """Like map_rows, but the function gets runs of rows whose column `weigh` adds up to about `limit` bytes, and may return any rows."""
    names = [f"c{i}" for i in range(len(columns))]
    inner = df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in df.sparkSession.createDataFrame([], schema).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        held: list[tuple] = []
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                for row in zip(*[part.column(i).to_pylist() for i in range(part.num_columns)], strict=True):
                    held.append(row)
                    size += len(row[weigh] or b"") + 192
                    if size >= limit:
                        if made := f(held):
                            yield _batch(made, out)
                        held, size = [], 0
        if held and (made := f(held)):
            yield _batch(made, out)

    return inner.mapInArrow(run, schema)
