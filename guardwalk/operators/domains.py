"""Domains of a plan's fields under all its constraints at once: bounds and values, or which constraints can't hold together.

Constraints are rows (plan, id, left, op, right, value) over whole numbers: `left op right` between
two fields of a plan or, where right is null, `left op value`; op is one of = <> < <= > >=.
`unread` tells the rows that aren't taken: `<>` between two fields, other ops, and rows without
plan, left, or anything to compare with. Ids are unique within a plan; repeated rows change
nothing. A domain is an interval less the values that `<>` excludes at its ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardwalk.operators import settled, together
from guardwalk.session import Rounds

#: Rows of a plan that a task takes at once; plans of more go by rounds.
SMALL = 1000
_READ = "plan IS NOT NULL AND left IS NOT NULL AND (op IN ('=', '<', '<=', '>', '>=') AND (right IS NOT NULL OR value IS NOT NULL) OR op = '<>' AND right IS NULL AND value IS NOT NULL)"
_STEP = "array<struct<field: string, id: string, by: bigint>>"


def unread(constraints: DataFrame) -> DataFrame:
    """Constraints that `solve` doesn't take, as they are."""
    return constraints.filter(f"NOT coalesce({_READ}, FALSE)")


def _bounds(c: DataFrame, low: bool) -> DataFrame:
    """(plan, field, bound, id): constraints with a value that bound a field from below, or from above."""
    strict = ">" if low else "<"
    by = F.when(F.col("op") == strict, 1 if low else -1).otherwise(0)
    one = c.filter(F.col("right").isNull() & F.col("op").isin("=", strict, strict + "="))
    return one.select("plan", F.col("left").alias("field"), (F.col("value") + by).cast("long").alias("bound"), "id")


def _edges(c: DataFrame) -> DataFrame:
    """(plan, u, v, by, id): v is u + by at least."""
    two = c.filter("right IS NOT NULL").withColumn("by", F.col("op").isin("<", ">").cast("long"))
    up = two.filter("op IN ('<', '<=', '=')").select("plan", F.col("left").alias("u"), F.col("right").alias("v"), "by", "id")
    return up.union(two.filter("op IN ('>', '>=', '=')").select("plan", F.col("right"), F.col("left"), "by", "id")).distinct()


def _passed(field: Column, bound: Column, steps: Column, out: Column) -> Column:
    """(bound, steps) behind the excluded values, in rising order, that the bound meets."""
    zero = F.struct(bound.alias("bound"), steps.alias("steps"))
    step = lambda e: F.array(F.struct(field.alias("field"), e["id"].alias("id"), F.lit(0).cast("long").alias("by")))
    take = lambda acc, e: F.when(e["value"] == acc["bound"], F.struct((acc["bound"] + 1).alias("bound"), F.concat(acc["steps"], step(e)).cast(_STEP).alias("steps"))).otherwise(acc)
    return F.aggregate(F.coalesce(out, F.array().cast("array<struct<value: bigint, id: string>>")), zero, take)


def _least(fields: DataFrame, bounds: DataFrame, edges: DataFrame, out: DataFrame, least: int, r: Rounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((plan, field, bound, steps), (plan, ids), (plan, field, bound, steps, out)): the least values, by which constraints they came about; the circles of plans that have none; what every field has by itself.

    Fields whose bound rose tell it to those above them until none rises. A circle of constraints that gains on every turn shows
    as soon as a bound comes back to its own field: it isn't run through till it leaves the domain.
    """
    start = F.array(F.struct("field", F.lit(None).cast("string").alias("id"), F.lit(0).cast("long").alias("by"))).cast(_STEP)
    own = bounds.groupBy("plan", "field").agg(F.min(F.struct((-F.col("bound")).alias("b"), "id")).alias("own")).select("plan", "field", (-F.col("own.b")).alias("bound"), "own.id")
    first = fields.join(own, ["plan", "field"], "left").join(out, ["plan", "field"], "left")
    told = F.array(F.struct("field", "id", F.lit(0).cast("long").alias("by"))).cast(_STEP)
    better = F.coalesce(F.col("bound") > least, F.lit(False))
    new = _passed(F.col("field"), F.when(better, F.col("bound")).otherwise(F.lit(least).cast("long")), F.when(better, told).otherwise(start), F.col("out"))
    state = r.cut(first.select("plan", "field", new.alias("new"), "out", F.lit(True).alias("moved")).select("plan", "field", "new.*", "out", "moved"))
    first = state
    circles: list[DataFrame] = []
    while True:
        tell = edges.join(state.filter("moved").select("plan", F.col("field").alias("u"), "bound", "steps"), ["plan", "u"])
        tell = tell.select("plan", F.col("v").alias("field"), (F.col("bound") + F.col("by")).alias("told"), F.concat("steps", F.array(F.struct(F.col("v").alias("field"), "id", "by"))).alias("way"))
        tell = r.cut(tell.join(state.select("plan", "field", "bound"), ["plan", "field"]).filter("told > bound"))
        way = F.col("way")
        turns = F.array_position(F.reverse(F.transform(F.slice(way, 1, F.size(way) - 1), lambda s: s["field"])), F.col("field")).cast("int")
        turn = F.when(turns > 0, F.slice(way, F.size(way) - turns + 1, turns))
        gains = tell.select("plan", turn.alias("turn")).filter("turn IS NOT NULL AND aggregate(turn, 0L, (a, s) -> a + s.by) > 0")
        ids = F.array_sort(F.array_distinct(F.transform("turn", lambda s: s["id"])))
        found = r.cut(gains.select("plan", ids.alias("ids")).groupBy("plan").agg(F.min(F.struct(F.size("ids"), "ids")).getField("ids").alias("ids")))
        circles.append(found)
        best = tell.groupBy("plan", "field").agg(F.min(F.struct((-F.col("told")).alias("b"), F.size("way").alias("n"), "way")).alias("best"))
        x = state.join(best, ["plan", "field"], "left").join(found.select("plan"), "plan", "left_anti")
        new = F.when(F.col("best").isNotNull(), _passed(F.col("field"), -F.col("best.b"), F.col("best.way"), F.col("out"))).otherwise(F.struct("bound", "steps"))
        state = r.cut(x.select("plan", "field", new.alias("new"), "out", F.col("best").isNotNull().alias("moved")).select("plan", "field", "new.*", "out", "moved"))
        if state.filter("moved").isEmpty():
            return state.select("plan", "field", "bound", "steps"), reduce(DataFrame.union, circles), first


def _derived(low: DataFrame, first: DataFrame, edges: DataFrame, r: Rounds) -> DataFrame:
    """`low` with steps that start from what fields have by themselves and lead over final bounds only.

    While bounds rise, one may be met by passing an excluded value although the bound that its neighbour has in the end leads there
    directly; the excluded value's constraint has no part in it then. Shorter ways come first; bounds that only lean on each
    other keep their steps.
    """
    both = first.select("plan", "field", F.col("bound").alias("alone"), F.col("steps").alias("own"), "out")
    all_ = r.cut(low.join(both, ["plan", "field"]))
    done = r.cut(all_.filter("bound = alone").select("plan", "field", "bound", F.col("own").alias("steps")))
    found, new = [done], done
    while not new.isEmpty():
        known = reduce(DataFrame.union, found).select("plan", "field")
        open_ = all_.select("plan", "field", F.col("bound").alias("want"), "out").join(known, ["plan", "field"], "left_anti")
        tell = edges.join(new.select("plan", F.col("field").alias("u"), "bound", "steps"), ["plan", "u"]).select("plan", F.col("v").alias("field"), (F.col("bound") + F.col("by")).alias("told"), F.concat("steps", F.array(F.struct(F.col("v").alias("field"), "id", "by"))).alias("way"))
        met = tell.join(open_, ["plan", "field"]).filter("told <= want").withColumn("to", _passed(F.col("field"), F.col("told"), F.col("way"), F.col("out"))).filter("to.bound = want")
        best = met.groupBy("plan", "field", "want").agg(F.min(F.struct((F.col("told") < F.col("want")).alias("late"), F.size("way").alias("n"), F.col("to.steps").alias("steps"))).alias("best"))
        new = r.cut(best.select("plan", "field", F.col("want").alias("bound"), "best.steps"))
        found.append(new)
    told = reduce(DataFrame.union, found).select("plan", "field", F.col("steps").alias("better"))
    return r.cut(low.join(told, ["plan", "field"], "left").select("plan", "field", "bound", F.coalesce("better", "steps").alias("steps")))


def solve(constraints: DataFrame, least: int, most: int) -> DataFrame:
    """(plan, field, lo, hi, conflict): the bounds of every field of a plan, or the plan's one row with ids that can't hold together.

    All fields lie in least to most. The values `lo` together meet all constraints that are taken, and so do the
    values `hi`. A conflict is the smallest, then least, of those found, one per field and circle. Without any one of its ids the
    others could hold, if it has no excluded values and the domain's own ends are left aside; where it is with
    an end of the domain, that has no id. Plans of up to SMALL rows are settled many at a time in one pass; larger ones, and those
    that it leaves, go by rounds, each of which is a join by plan and field.
    """
    r = Rounds(constraints.sparkSession)
    c = r.cut(constraints.filter(_READ).select("plan", F.col("id").cast("string").alias("id"), F.col("left").cast("string").alias("left"), "op", F.col("right").cast("string").alias("right"), F.col("value").cast("long").alias("value")))
    if not together.known(c.schema["plan"].dataType):
        out = r.kept(_by_rounds(c.distinct(), least, most, r))
        r.close()
        return out
    large = r.cut(c.groupBy("plan").count().filter(F.col("count") > SMALL).select("plan"))
    few = c if large.isEmpty() else c.join(large, "plan", "left_anti")
    done = r.kept(settled.settle(few, least, most))
    left = large.union(done.filter("left").select("plan"))
    out = done.filter("NOT left").drop("left")
    if not left.isEmpty():
        out = out.union(r.kept(_by_rounds(c.join(left, "plan", "left_semi").distinct(), least, most, r)))
    r.close()
    return out


def _by_rounds(constraints: DataFrame, least: int, most: int, r: Rounds) -> DataFrame:
    """`solve` of plans of any size."""
    c = r.cut(constraints)
    edges = r.cut(_edges(c))
    fields = r.cut(c.select("plan", F.col("left").alias("field")).union(c.filter("right IS NOT NULL").select("plan", "right")).distinct())
    gone = c.filter("op = '<>'").groupBy("plan", F.col("left").alias("field"), "value").agg(F.min("id").alias("id"))
    out = lambda sign: r.cut(gone.groupBy("plan", "field").agg(F.array_sort(F.collect_list(F.struct((F.col("value") * sign).alias("value"), "id"))).alias("out")))
    low, circles, first = _least(fields, _bounds(c, True), edges, out(1), least, r)

    caps = _bounds(c, False).union(fields.select("plan", "field", F.lit(most).cast("long"), F.lit(None).cast("string")))
    worst = caps.groupBy("plan", "field").agg(F.min("bound").alias("cap"))
    hurt = r.cut(low.join(worst, ["plan", "field"]).filter("bound > cap").select("plan").distinct())
    low_hurt = _derived(low.join(hurt, "plan", "left_semi"), first, edges, r)
    broken = low_hurt.join(caps, ["plan", "field"]).filter(low_hurt["bound"] > caps["bound"])
    ids = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform("steps", lambda s: s["id"]), F.array(caps["id"])))))
    clashes = broken.select("plan", ids.alias("ids")).union(circles)
    conflict = r.cut(clashes.groupBy("plan").agg(F.min(F.struct(F.size("ids"), "ids")).getField("ids").alias("conflict")))

    fine = lambda df: df.join(conflict.select("plan"), "plan", "left_anti")
    turned = _bounds(c, False).withColumn("bound", -F.col("bound"))
    high, _, _ = _least(fine(fields), fine(turned), fine(edges).select("plan", F.col("v").alias("u"), F.col("u").alias("v"), "by", "id"), out(-1), -most, r)
    both = fine(low).select("plan", "field", F.col("bound").alias("lo")).join(high.select("plan", "field", (-F.col("bound")).alias("hi")), ["plan", "field"])
    none = F.lit(None)
    return both.withColumn("conflict", none.cast("array<string>")).unionByName(conflict.select("plan", none.cast("string").alias("field"), none.cast("long").alias("lo"), none.cast("long").alias("hi"), "conflict"))
