"""Numbers and runs of rows in the order of their key, without a window over a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardwalk.session import Rounds

#: A key of up to so many rows is sorted in one task; one of more lies in ranges.
HOT = 100_000


def runs(df: DataFrame, key: str, order: list[str], value: str, rounds: Rounds) -> DataFrame:
    """`df` with `call`, a row's number from 1 under its key, `run`, the number from 1 of its run of equal values, and `fresh`, whether a run begins there.

    Rows stand by `order`, then by the JSON text of all their columns; which of two rows that are equal
    in all comes first is left open. Null keys are one key, null values one value.
    """
    cold, hot, _ = parts(df, key, order, value, rounds)
    return cold if hot is None else cold.union(hot)


def parts(df: DataFrame, key: str, order: list[str], value: str, rounds: Rounds) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """`runs` of the keys of up to HOT rows; that of the others, and these keys as `_key`, both None if there are none."""
    k = F.col(f"`{key}`")
    keys = rounds.cut(df.groupBy(k.alias("_key")).count().filter(F.col("count") > HOT).select("_key"))
    if keys.isEmpty():
        return _sorted(df, key, order, value), None, None
    apart = lambda how: df.join(F.broadcast(keys), k.eqNullSafe(F.col("_key")), how)
    return _sorted(apart("left_anti"), key, order, value), _ranged(apart("left_semi"), key, order, value, rounds), keys


def _text(df: DataFrame):
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def _sorted(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """A key's rows in one task."""
    here = Window.partitionBy(f"`{key}`").orderBy(*[F.col(f"`{c}`") for c in order], "_text")
    v = F.col(f"`{value}`")
    x = df.select("*", _text(df).alias("_text"))
    x = x.select("*", F.row_number().over(here).cast("long").alias("_call"), F.lag(v).over(here).alias("_before"))
    x = x.select("*", ((F.col("_call") == 1) | ~F.col("_before").eqNullSafe(v)).alias("_fresh"))
    run = F.sum(F.col("_fresh").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, 0))
    return x.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_call").alias("call"), run.alias("run"), F.col("_fresh").alias("fresh"))


def _ranged(df: DataFrame, key: str, order: list[str], value: str, rounds: Rounds) -> DataFrame:
    """Rows go into ranges of (key, order, text), so a hot key has as many ranges as its rows ask for. Ranges tell each other one row each: their last row
    and where the key that they end with began.
    """
    names = df.columns
    x = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col(f"`{key}`").alias("k"), F.struct(*[F.col(f"`{c}`") for c in order], _text(df)).alias("o"), F.col(f"`{value}`").alias("v"))
    line = ["k", "o", "copy"]
    rows = rounds.cut(x.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*line).withColumn("part", F.spark_partition_id()))

    row = Window.orderBy("part")  # a row a partition
    last = F.struct("k", "v")
    ends = rows.groupBy("part").agg(F.max_by(last, F.struct(*line)).alias("end"))
    left = ends.select("part", F.lag("end").over(row).alias("left"))
    here = Window.partitionBy("part").orderBy(*line)
    y = rows.join(F.broadcast(left), "part").withColumn("before", F.coalesce(F.lag(last).over(here), "left"))
    begins = F.col("before").isNull() | ~F.col("before.k").eqNullSafe(F.col("k"))
    y = y.withColumn("begins", begins).withColumn("fresh", begins | ~F.col("before.v").eqNullSafe(F.col("v")))
    here_so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    y = y.select("part", *line, "r", "begins", "fresh", F.row_number().over(here).alias("at"), F.sum(F.col("fresh").cast("long")).over(here_so_far).alias("g"))
    y = rounds.cut(y.withColumn("start", F.last(F.when(F.col("begins"), F.struct("at", "g")), True).over(here_so_far)).drop(*line))

    sums = y.groupBy("part").agg(F.count("*").alias("n"), F.max("g").alias("gs"), F.max("start").alias("start"))
    so_far = row.rowsBetween(Window.unboundedPreceding, -1)
    told = sums.select("part", "start", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("n"), F.coalesce(F.sum("gs").over(so_far), F.lit(0)).alias("gs"))
    whole = told.withColumn("start", F.when(F.col("start").isNotNull(), F.struct((F.col("n") + F.col("start.at")).alias("at"), (F.col("gs") + F.col("start.g")).alias("g"))))
    whole = whole.select("part", "n", "gs", F.last("start", True).over(so_far).alias("carried"))
    z = y.join(F.broadcast(whole), "part")
    at = F.coalesce(F.col("n") + F.col("start.at"), "carried.at")
    g = F.coalesce(F.col("gs") + F.col("start.g"), "carried.g")
    return z.select("r.*", (F.col("n") + F.col("at") - at + 1).alias("call"), (F.col("gs") + F.col("g") - g + 1).alias("run"), "fresh")
