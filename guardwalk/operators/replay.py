"""Series of outcomes as a harness can hold them: what it refuses stays in its place, so that later outcomes stay on their calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardwalk.operators import sequences
from guardwalk.session import Rounds


def _nothing():
    return F.create_map().cast("map<string,string>")


def _upper_keys(m):
    """The map with names in upper case; of names that differ in case only the last in order counts."""
    pairs = F.array_sort(F.map_entries(m))
    return F.aggregate(pairs, _nothing(), lambda a, e: F.map_concat(F.map_filter(a, lambda k, _: k != F.upper(e["key"])), F.create_map(F.upper(e["key"]), e["value"])))


def _offered(profile: DataFrame) -> DataFrame:
    """(op, fields, most), one row an operation: fields together, the least limit."""
    x = profile.select(F.upper("op").alias("op"), "most", F.explode_outer("fields").alias("f"))
    return x.groupBy("op").agg(F.collect_set(F.upper("f")).alias("fields"), F.min(F.when(F.col("most") > 0, F.col("most"))).alias("most"))


def series(planned: DataFrame, order: list[str], profile: DataFrame) -> DataFrame:
    """(op, call, status, set, refused, run): a row per planned outcome, at the call it was planned for.

    planned: (op, set map<string,string>) and the columns of `order`; profile: (op, fields, most), `most` null or 0 without a
    limit. status: `kept`, `empty` (kept in its place with no field that the harness can set), `beyond` (the harness holds no more outcomes),
    `no operation` (nothing of it can be replayed). set holds the fields that are set, refused the others' names, sorted; run
    numbers the stretches of outcomes that set something and that don't, in turn; it is null beyond the limit. Names count in
    upper case. A null map sets nothing; rows without an operation have no operation.
    """
    r = Rounds(planned.sparkSession)
    p = planned.select(F.upper("op").alias("op"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("place"), _upper_keys(F.coalesce("set", _nothing())).alias("wanted"))
    x = p.join(_offered(profile).withColumn("known", F.lit(True)), "op", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    can = F.coalesce("fields", F.array().cast("array<string>"))
    x = x.withColumn("set", F.map_filter("wanted", lambda k, _: F.array_contains(can, k))).withColumn("refused", F.array_sort(F.array_except(F.map_keys("wanted"), F.map_keys("set"))))
    x = x.select("op", "place", "known", "most", "set", "refused", (F.size("set") > 0).alias("sets"))
    y = sequences.runs(x, "op", ["place"], "sets", r)
    status = F.when(~F.col("known"), "no operation").when(F.col("call") > F.col("most"), "beyond").when(F.col("sets"), "kept").otherwise("empty")
    return r.last(y.select("op", "call", status.alias("status"), "set", "refused", F.when(~(status == "beyond"), F.col("run")).alias("run")))


def endings(terminals: DataFrame, profile: DataFrame) -> DataFrame:
    """(op, terminal): what a harness can set of (op, set) once a series is over, an operation's rows together, names in upper case; null if nothing."""
    x = terminals.select(F.upper("op").alias("op"), F.explode("set").alias("f", "v")).select("op", F.upper("f").alias("f"), "v").groupBy("op", "f").agg(F.max("v").alias("v"))
    offered = _offered(profile).select("op", F.explode("fields").alias("f"))
    return x.join(offered, ["op", "f"]).groupBy("op").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("f", "v")))).alias("terminal"))


def replayed(calls: DataFrame, order: list[str], held: DataFrame, ends: DataFrame) -> DataFrame:
    """(called, call, source, set): what the n-th call of an operation, by `order`, gets of a series (`series`) and its ending (`endings`).

    source: `outcome`, `terminal`, or `none` where the series is over and has no ending; calls of operations without either are `none` too. called is a struct of the call's columns.
    """
    r = Rounds(calls.sparkSession)
    c = calls.select(F.struct(*[F.col(f"`{c}`") for c in calls.columns]).alias("called"), F.upper(F.col("op")).alias("op"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("place"))
    cold, hot, ops = sequences.parts(c.withColumn("same", F.lit(0)), "op", ["place"], "same", r)
    n = cold.select("called", "op", "call").join(ends, "op", "left")
    if hot is not None:  # of few operations: their endings go to every task
        few = ends.join(F.broadcast(ops), F.col("op") == F.col("_key"), "left_semi")
        n = n.union(hot.select("called", "op", "call").join(F.broadcast(few), "op", "left"))
    got = n.join(delivered(held), ["op", "call"], "left")
    source = F.when(F.col("set").isNotNull(), "outcome").when(F.col("terminal").isNotNull(), "terminal").otherwise("none")
    return r.last(got.select("called", "call", source.alias("source"), F.coalesce("set", "terminal").alias("set")))


def delivered(held: DataFrame) -> DataFrame:
    """(op, call, set) of a series' outcomes that are delivered, those that set nothing included."""
    return held.filter("status IN ('kept', 'empty')").select("op", "call", "set")
