"""Origins of bytes: which write holds every byte interval of a record, and where its bytes came from.

A write puts `source` from byte `source_lo` on into bytes `lo` (included) to `hi` (excluded) of
`record`; of several the greatest `seq` wins, then the greatest source and offset. Intervals are
cut into dyadic blocks, whose latest write is a plain maximum: it is aggregated before the
shuffle, however many writes meet in one record. No row is made per byte, no record is
collected or put in one window. Writes without record, bounds or bytes write nothing; a null seq
is older than any other, a null source is a source of its own. Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardwalk.operators import together
from guardwalk.session import Rounds, numbered

#: Writes of a record that a task takes at once, and rows that it works on together; records of more writes go by blocks.
SMALL, ROWS = 2000, 200_000
BAND = 6  # levels that a block looks upwards at a time: a block of 2^6 others at most meets one


def _down(x: Column, levels: Column) -> Column:
    return F.call_function("shiftright", x, levels.cast("int"))


def _up(x: Column, levels: Column) -> Column:
    return F.call_function("shiftleft", x, levels.cast("int"))


def blocks(lo: Column, hi: Column) -> Column:
    """The dyadic blocks (level, at) that make up lo to hi, two a level at most; block `at` of a level covers 2^level bytes from at * 2^level on."""
    lo, hi = lo.cast("long"), hi.cast("long")
    spans = F.transform(F.sequence(F.lit(0), F.length(F.bin(hi - lo)) - 1), lambda lv: F.struct(lv.alias("level"), (-_down(-lo, lv)).alias("l"), _down(hi, lv).alias("r")))
    took = lambda at: F.filter(spans, lambda s: (s["l"] < s["r"]) & (s[at] % 2 == 1))
    block = lambda at, less: F.transform(took(at), lambda s: F.struct(s["level"].alias("level"), (s[at] - less).alias("at")))
    return F.concat(block("l", 0), block("r", 1))


def _above(df: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    """Every block beside the blocks (up, up_at) that hold it, from level `first` to `last`; nothing where first is beyond last."""
    levels = F.filter(F.sequence(F.col("level"), F.greatest(F.lit(last), F.col("level"))), lambda v: v.between(first, last))
    return df.withColumn("up", F.explode(levels)).withColumn("up_at", _down(F.col("at"), F.col("up") - F.col("level")))


def overlay(writes: DataFrame) -> DataFrame:
    """(record, lo, hi, seq, source, source_lo): the latest write of every byte that any wrote, in the longest intervals of one write.

    Records of up to SMALL writes are worked out many at a time, after one exchange by record; the others, found by a count, by blocks.
    """
    r = Rounds(writes.sparkSession)
    taken = writes.filter("record IS NOT NULL AND lo >= 0 AND lo < hi").select("record", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "seq", "source", (F.col("source_lo") - F.col("lo")).cast("long").alias("shift"))
    if not together.known(taken.schema["record"].dataType):
        out = r.kept(_by_blocks(taken, r))
    else:
        large = r.cut(taken.groupBy("record").count().filter(F.col("count") > SMALL).select("record"))
        if large.isEmpty():
            out = r.kept(_at_once(taken))
        else:
            out = r.kept(_at_once(taken.join(large, "record", "left_anti"))).union(r.kept(_by_blocks(taken.join(large, "record", "left_semi"), r)))
    r.close()
    return out


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Which values of two arrays are equal, nulls and NaNs to their like."""
    if pa.types.is_nested(a.type) and not pa.types.is_struct(a.type):
        return np.fromiter((x == y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)), bool, len(a))
    none, other = a.is_null().to_numpy(zero_copy_only=False), b.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_null(a.type):
        return none
    if pa.types.is_struct(a.type):
        equal = np.ones(len(a), bool)
        for x, y in zip(a.flatten(), b.flatten(), strict=True):
            equal &= _same(x, y)
    else:
        equal = pc.equal(a, b)
        if pa.types.is_floating(a.type):
            equal = pc.or_(equal, pc.and_(pc.is_nan(a), pc.is_nan(b)))
        equal = equal.fill_null(False).to_numpy(zero_copy_only=False)
    return np.where(none | other, none & other, equal)


def _at_once(writes: DataFrame) -> DataFrame:
    """`overlay` of records whose writes fit in a task many times over. Spark's order by value is the writes' order; which write holds each part is then a maximum over ranges."""
    kinds = writes.schema
    schema = T.StructType([kinds["record"], kinds["lo"], kinds["hi"], kinds["seq"], kinds["source"], T.StructField("source_lo", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in together.groups(batches, "record", ROWS):
            yield _latest(t)

    rows = writes.select("record", "seq", "source", "shift", "lo", "hi").repartition("record").sortWithinPartitions("record", "seq", "source", "shift")
    return rows.mapInArrow(run, schema)


def _latest(t: pa.Table) -> pa.RecordBatch:
    n, first = t.num_rows, together.begins(t.column("record"))
    record = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    held = {c: together.one(t.column(c)) for c in ("record", "seq", "source")}
    lo, hi = (together.one(t.column(c)).to_numpy() for c in ("lo", "hi"))
    shift = together.one(t.column("shift"))
    nowhere, shift = shift.is_null().to_numpy(zero_copy_only=False), shift.fill_null(0).to_numpy()
    fresh = np.ones(n, bool)
    fresh[1:] = (record[1:] != record[:-1]) | (shift[1:] != shift[:-1]) | (nowhere[1:] != nowhere[:-1])
    for c in ("seq", "source"):
        fresh[1:] |= ~_same(held[c][1:], held[c][:-1])
    value = np.cumsum(fresh)

    # places where anything begins or ends; a part reaches from one to the next
    x, of = np.concatenate([lo, hi]), np.concatenate([record, record])
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    new = np.ones(2 * n, bool)
    new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
    at = np.empty(2 * n, np.int64)
    at[order] = np.cumsum(new) - 1
    place, begin, end = x[new], at[:n], at[n:]

    # the greatest write of every range of 2^k parts; two such ranges make up a write
    level = np.frexp((end - begin).astype(float))[1] - 1
    top = np.full(len(place), -1, np.int64)
    for k in range(int(level.max()), -1, -1):
        here = np.flatnonzero(level == k)
        np.maximum.at(top, begin[here], here)
        np.maximum.at(top, end[here] - (1 << k), here)
        if k:
            half = 1 << (k - 1)
            down = top.copy()
            np.maximum(down[half:], top[:-half], out=down[half:])
            top = down
    mine = np.where(top >= 0, value[top], 0)
    starts = np.flatnonzero((mine > 0) & (mine != np.concatenate([[0], mine[:-1]])))
    ends = np.flatnonzero((mine > 0) & (mine != np.concatenate([mine[1:], [0]])))
    row = top[starts]
    rows = pa.array(row)
    return pa.RecordBatch.from_arrays([held["record"].take(rows), pa.array(place[starts]), pa.array(place[ends + 1]), held["seq"].take(rows), held["source"].take(rows), pa.array(shift[row] + place[starts], mask=nowhere[row])], names=["record", "lo", "hi", "seq", "source", "source_lo"])


def _by_blocks(writes: DataFrame, r: Rounds) -> DataFrame:
    """`overlay` of records with any number of writes.

    Blocks that hold smaller ones are halved until a block has one latest write: the greatest of its own and of all
    that hold it, which bands of levels pass down from the top.
    """
    key = ["record", "level", "at"]
    value = F.struct("seq", "source", "shift")
    each = writes.select("record", F.explode(blocks(F.col("lo"), F.col("hi"))).alias("b"), value.alias("value"))
    own = r.cut(each.groupBy("record", F.col("b.level").alias("level"), F.col("b.at").alias("at")).agg(F.max("value").alias("value")))
    top = own.agg(F.max("level")).first()[0] or 0
    held = r.cut(_above(own.select(*key), F.col("level") + 1, top).select("record", F.col("up").alias("level"), F.col("up_at").alias("at")).distinct())
    halves = held.select("record", (F.col("level") - 1).alias("level"), F.explode(F.array(F.col("at") * 2, F.col("at") * 2 + 1)).alias("at"))
    leaves = r.cut(halves.union(own.select(*key)).distinct().join(held, key, "left_anti"))
    told: list[DataFrame] = []
    passed = None
    for low in range(top // BAND * BAND, -1, -BAND):
        below = held.filter(F.col("level") == low).withColumn("leaf", F.lit(False))
        ask = leaves.filter(F.col("level").between(low, low + BAND - 1)).withColumn("leaf", F.lit(True)).union(below)
        known = own.filter(F.col("level").between(low, low + BAND - 1))
        if passed is not None:
            known = known.union(passed)
        up = known.select("record", F.col("level").alias("up"), F.col("at").alias("up_at"), "value")
        got = _above(ask, low, low + BAND).join(up, ["record", "up", "up_at"]).groupBy(*key, "leaf").agg(F.max("value").alias("value"))
        got = r.cut(got)
        told.append(got.filter("leaf").select(*key, "value"))
        passed = got.filter("NOT leaf").select(*key, "value")
    lo, size = _up(F.col("at"), F.col("level")), F.expr("shiftleft(1L, level)")
    parts = r.cut(reduce(DataFrame.union, told).select("record", lo.alias("lo"), (lo + size).alias("hi"), "value"))
    return _joined(parts, r)


def _joined(parts: DataFrame, r: Rounds) -> DataFrame:
    """Neighbours with one value become one interval: the n-th that has none before it begins what the n-th without one behind it ends."""
    met = lambda mine, other: parts.alias("p").join(
        parts.select("record", F.col(other).alias("edge"), "value").alias("q"),
        (F.col("p.record") == F.col("q.record")) & (F.col(f"p.{mine}") == F.col("edge")) & F.col("p.value").eqNullSafe(F.col("q.value")),
        "left_anti",
    )
    starts, ends = met("lo", "hi").select("record", "lo", "value"), met("hi", "lo").select("record", "hi")
    both = numbered(starts, ["record", "lo"], r).join(numbered(ends, ["record", "hi"], r).drop("record"), "number")
    return both.select("record", "lo", "hi", "value.seq", "value.source", (F.col("value.shift") + F.col("lo")).alias("source_lo"))


def overlaps(a: DataFrame, b: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(record, lo, hi, and the columns of both): the shared bytes of every two intervals of two tables that share any.

    Both have (record, lo, hi) and one column more, `a` and `b`. Two dyadic blocks overlap only if one holds the other, so it is an
    equality join of blocks with the blocks that hold those of the other side; of two intervals' common blocks the one where the shared bytes begin answers for all. With `rounds`
    both sides' blocks are files first, so that Spark sees how small a side is: the other one's hot records stay where they are then.
    """
    put = rounds.cut if rounds else lambda df: df
    cut = lambda df, name: df.filter("record IS NOT NULL AND lo >= 0 AND lo < hi").select("record", F.explode(blocks(F.col("lo"), F.col("hi"))).alias("k"), F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), name).alias(name)).select("record", "k.level", "k.at", name)
    x, y = put(cut(a, "a")), put(cut(b, "b"))
    top = max(df.agg(F.max(F.length(F.bin("hi")))).first()[0] or 0 for df in (a, b))
    inside = _above(x, F.col("level"), top).join(y.select("record", F.col("level").alias("up"), F.col("at").alias("up_at"), "b"), ["record", "up", "up_at"])
    around = _above(y, F.col("level") + 1, top).join(x.select("record", F.col("level").alias("up"), F.col("at").alias("up_at"), "a"), ["record", "up", "up_at"])
    lo, hi = F.greatest("a.lo", "b.lo"), F.least("a.hi", "b.hi")
    pairs = inside.select("record", "level", "at", "a", "b").union(around.select("record", "level", "at", "a", "b"))
    return pairs.filter(_up(F.col("at"), F.col("level")) == lo).select("record", lo.alias("lo"), hi.alias("hi"), F.col("a.a").alias("a"), F.col("b.b").alias("b"))


def compose(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(record, lo, hi, source, source_lo): the origins of `outer`, followed through the records that `inner` tells the origins of.

    Both are results of `overlay`. A slice of a slice is a slice: what `inner` knows is laid over `outer`, bytes that it
    doesn't know keep their source. Sources and records are of one type.
    """
    size = F.col("hi") - F.col("lo")
    a = outer.select(F.col("source").alias("record"), F.col("source_lo").alias("lo"), (F.col("source_lo") + size).alias("hi"), F.struct("record", (F.col("lo") - F.col("source_lo")).alias("move")).alias("a"))
    b = inner.select("record", "lo", "hi", F.struct("source", (F.col("source_lo") - F.col("lo")).alias("shift")).alias("b"))
    r = Rounds(outer.sparkSession)
    deeper = overlaps(a, b, r).select(F.col("a.record").alias("record"), (F.col("lo") + F.col("a.move")).alias("lo"), (F.col("hi") + F.col("a.move")).alias("hi"), F.lit(1).alias("seq"), F.col("b.source").alias("source"), (F.col("lo") + F.col("b.shift")).alias("source_lo"))
    whole = r.cut(outer.select("record", "lo", "hi", F.lit(0).alias("seq"), "source", "source_lo").union(deeper))
    out = overlay(whole).drop("seq")
    r.close()
    return out
