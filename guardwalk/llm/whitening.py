"""Embedding whitening from a polarisation covariance.

Entries become whole numbers x = floor(256 * entry). The fit list is every distinct
x vector once. A first pass over it gives its length n and each dimension's sum S; a
second one adds up, exactly, the squares of the centred values of every dimension and
of every sum of two dimensions, which is all that the tasks emit:

    n^2 var(a) = sum of (n x_a - S_a)^2 / n,   cov(a, b) = (var(a + b) - var(a) - var(b)) / 2

so the cross-covariances are differences of variances. Whole numbers near the mean
(y = x - floor(S / n)) are squared instead of n x - S, and the difference between both
centres is put right at the end in Python's unbounded integers, so nothing is rounded
before the covariance matrix is: sum of (n x - S)^2 = n (n sum of y^2 - (sum of y)^2).
The matrix goes to eigh on the driver; its size is that of a vector squared, whatever
the number of rows. A vector's squares are taken in 64 bits where they fit and in
Python's integers where they don't.

Defined results: vectors that are null or hold a null, NaN or infinite entry go; an
entry beyond 64 bits takes the nearest 64-bit number; shorter vectors have zeros for
the dimensions they lack; repeated rows and equal vectors each get their rows, with
equal values; a null id stays null. Components without variance (fewer different
vectors or dimensions than asked for) have no rows, so an empty table, or one whose
vectors are all equal, gives an empty table. Each component's entry of largest size is
positive. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardwalk.llm.neardup import Tables

SCALE, COMPONENTS = 256, 4
#: Rows of a batch that are squared at once: bounds a task's memory.
ROWS = 1024


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): whole vectors only, entries as 64-bit whole numbers."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = vectors[vec_col].cast("array<double>")
    whole = vectors.filter(vectors[vec_col].isNotNull() & ~F.coalesce(F.exists(v, odd), F.lit(False)))
    return whole.select(vectors[id_col].alias("vec_id"), F.transform(v, lambda c: F.floor(c * scale)).alias("x"))


def padded(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix of 64-bit integers, zeros for what a row lacks."""
    sizes = np.asarray(pc.list_value_length(column))
    flat = np.asarray(column.flatten()).astype(np.int64, copy=False)
    if len(sizes) * dims == len(flat) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def centred(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """x - middle, in 64 bits if a batch's squares of sums of two fit there, else in Python's integers."""
    lows, highs = (x.min(0).tolist(), x.max(0).tolist()) if len(x) else ([], [])
    most = max([0, *(max(h - m, m - l) for h, l, m in zip(highs, lows, middle, strict=bool(highs)))])
    exact = np.int64 if 4 * most * most * ROWS < 1 << 62 else object
    return x.astype(exact) - np.array(middle, dtype=exact)


def totals(rows: DataFrame, dims: int, make: Callable[[np.ndarray], Iterator[tuple[int, int, int]]]) -> dict[tuple[int, int], int]:
    """Sums by (i, j) of what `make` gives for parts of the x vectors: tasks add up before the shuffle, and a row for each (i, j) comes back."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                for i, j, s in make(padded(b.column(0).slice(at, ROWS), dims)):
                    held[i, j] = held.get((i, j), 0) + s
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([str(s) for s in held.values()])], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for b in batches:
            for i, j, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
                held[i, j] = held.get((i, j), 0) + int(s)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([str(s) for s in held.values()])], schema=schema)

    kind = "i int, j int, s string"  # sums have no bound, so they travel as text
    return {(r["i"], r["j"]): int(r["s"]) for r in rows.select("x").mapInArrow(run, kind).repartition("i", "j").mapInArrow(add, kind).collect()}


def sums(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(dimension, -1, sum of its values), and the rows at (-1, -1)."""
    yield -1, -1, len(x)
    wide = x if not len(x) or np.abs(x.astype(np.float64)).max(initial=0) < 1 << 50 else x.astype(object)
    for i, s in enumerate(wide.sum(0)):
        yield i, -1, int(s)


def squares(x: np.ndarray, middle: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, i, sum of squares) and, for i < j, (i, j, sum of the squares of both dimensions' sum)."""
    y = centred(x, middle)
    for i in range(y.shape[1]):
        z = y[:, i:] + y[:, i : i + 1]
        z[:, 0] = y[:, i]
        for j, s in enumerate((z * z).sum(0)):
            yield i, i + j, int(s)


class Fit:
    """n, sums and the whitening matrix of a fit list."""

    def __init__(self, n: int, total: list[int], variances: dict[tuple[int, int], int], middle: list[int], components: int):
        """`variances` holds sums of squares of y = x - middle, of dimensions and of sums of two."""
        d = len(total)
        self.n, self.total, self.middle = n, total, middle
        rest = [s - n * m for s, m in zip(total, middle, strict=True)]  # sums of y
        # n times the sum of squares around the true mean, of a dimension and of a sum of two
        var = {(i, j): n * q - (rest[i] + (rest[j] if i != j else 0)) ** 2 for (i, j), q in variances.items()}
        cov = [[Fraction(0)] * d for _ in range(d)]
        for i in range(d):
            for j in range(i, d):
                cov[i][j] = cov[j][i] = Fraction(var[i, i], n * n) if i == j else Fraction(var[i, j] - var[i, i] - var[j, j], 2 * n * n)
        self.cov = np.array([[float(c) for c in row] for row in cov]).reshape(d, d)
        self.trace = float(sum((cov[i][i] for i in range(d)), Fraction(0)))
        e, v = np.linalg.eigh(self.cov) if d else (np.zeros(0), np.zeros((0, 0)))
        order = [k for k in np.argsort(-e, kind="stable")[:components] if e[k] > 64 * d * np.finfo(float).eps * max(e)]
        self.values, self.vectors = e[order], v[:, order]
        for k in range(len(order)):
            w = self.vectors[:, k]
            self.vectors[:, k] = w if w[np.argmax(np.abs(w))] > 0 else -w
        self.rest = np.array([float(Fraction(r, n)) for r in rest]) if n else np.zeros(d)
        self.rest_n = rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """(x - S/n) on the components, over the roots of their eigenvalues."""
        return (centred(x, self.middle).astype(np.float64) - self.rest) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exact."""
        y = centred(x, self.middle)
        most = self.n * int(max(abs(y.max(initial=0)), abs(y.min(initial=0)))) + max([0, *map(abs, self.rest_n)])
        y = y.astype(np.int64 if most * most * max(1, y.shape[1]) < 1 << 62 else object)
        return [int(q) for q in ((self.n * y - np.array(self.rest_n, dtype=y.dtype)) ** 2).sum(1)]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The whitening of a stored list of different x vectors; None if there are none."""
    dims = distinct.agg(F.max(F.size("x"))).first()[0]
    if dims is None:
        return None
    first = totals(distinct, dims, sums)
    n, total = first[-1, -1], [first[i, -1] for i in range(dims)]
    middle = [s // n for s in total]
    return Fit(n, total, totals(distinct, dims, lambda x: squares(x, middle)), middle, components)


def identity_error(distinct: DataFrame, f: Fit) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity), measured on the values themselves."""
    k = len(f.values)
    white = whitened(distinct.withColumn("vec_id", F.lit(None).cast("long")), f, arrays=True)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(row, pairs, strict=True))


def whitened(vectors: DataFrame, f: Fit, arrays: bool = False) -> DataFrame:
    """(vec_id, deviation, w): a row per vector with all its whitened values; without `arrays`, (vec_id, component, deviation, whitened)."""
    dims, kind = len(f.total), dict(vectors.dtypes)["vec_id"]
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"vec_id {kind}, deviation decimal(38,0), w array<double>"
    out = to_arrow_schema(vectors.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                ids, x = b.column(0).slice(at, ROWS), padded(b.column(1).slice(at, ROWS), dims)
                w = f.whiten(x)
                yield pa.RecordBatch.from_arrays([ids, pa.array([decimal.Decimal(q) if q < 10**38 else None for q in f.deviation(x)], out.field(1).type), pa.array(list(w), out.field(2).type)], schema=out)

    rows = vectors.select("vec_id", "x").mapInArrow(run, schema)
    return rows if arrays else rows.select("vec_id", F.posexplode("w").alias("component", "whitened"), "deviation").withColumn("component", F.col("component") + 1)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector that is whole.

    `deviation` is a decimal, null beyond 38 digits.
    """
    t = Tables(vectors.sparkSession)
    rows = quantised(vectors, id_col, vec_col)
    distinct = t.cut(rows.select("x").distinct())
    f = fit(distinct, components)
    if f is None or not len(f.values):
        empty = rows.filter("false").select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"))
        t.drop()
        return empty.select("*", *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    error = identity_error(distinct, f)
    t.drop()
    share = F.element_at(F.array(*[F.lit(float(e) / f.trace) for e in f.values]), F.col("component"))
    value: list[Column] = [F.lit(f.n).cast("long").alias("n"), F.col("deviation"), F.col("whitened"), share.alias("explained"), F.lit(float(error)).alias("identity_error")]
    return whitened(rows, f).select("vec_id", "component", *value)


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns; a deviation beyond 64 bits is null."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
