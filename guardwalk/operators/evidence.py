"""Values for fields and outcomes for operations, chosen from what programs and runs say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relations with their sides exchanged.
FLIPPED = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def flipped(op: Column) -> Column:
    """The relation that holds with the sides exchanged."""
    return F.coalesce(*[F.when(op == a, b) for a, b in FLIPPED.items()])


def companion(op: Column, pinned: Column) -> Column:
    """A whole number x with `x op pinned`, as near to it as can be."""
    return F.when(op.isin("=", "<=", ">="), pinned).when(op.isin(">", "<>"), pinned + 1).when(op == "<", pinned - 1)


def ranked(candidates: DataFrame, slot: str, category: str, order: list[str]) -> DataFrame:
    """Candidates with `rank` within their slot: by the category's place in `order` (others last), then as they stand (`pos`)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(category))
    by = Window.partitionBy(slot).orderBy(F.when(place == 0, len(order) + 1).otherwise(place), "pos")
    return candidates.withColumn("rank", F.row_number().over(by))


def best_evidence(texts: DataFrame, slot: str, text: str) -> DataFrame:
    """(slot, text): the longest text seen for a slot, of equal ones the first by code point."""
    return texts.groupBy(slot).agg(F.min_by(text, F.struct(-F.length(text), F.col(text))).alias(text))


def complement(domains: DataFrame, compared: DataFrame) -> DataFrame:
    """(field, value): the first value (by `pos`) of a field's domain that it is compared with nowhere."""
    return domains.join(compared.select("field", "value"), ["field", "value"], "left_anti").groupBy("field").agg(F.min_by("value", "pos").alias("value"))


def conforming(kind: Column, width: Column) -> Column:
    """A text of a picture's class and width."""
    fill = F.when(kind == "numeric", "1").when(kind == "alphabetic", "A").otherwise("X")
    return F.repeat(fill, width)


def merged_models(models: DataFrame, key: str = "field", order: str = "src_order") -> DataFrame:
    """One row a field: the later source wins, children of all sources are kept in order of first sight."""
    won = models.groupBy(key).agg(F.max_by(F.struct("pic", "parent"), order).alias("w"))
    child = models.groupBy("parent", key).agg(F.min(F.struct(order, "pos")).alias("at")).filter("parent IS NOT NULL")
    children = child.groupBy(F.col("parent").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(key).alias("c")))), lambda x: x["c"]).alias("children"))
    return won.join(children, F.col(key) == F.col("p"), "left").select(key, "w.pic", "w.parent", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def record_group(fields: DataFrame, groups: DataFrame, least: int = 2) -> DataFrame:
    """(field, record, score): of the records, that which shares the most name tokens with a field, at least `least`; ties by name."""
    parts = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(F.upper(F.col(c)), "-"))).alias("token")).filter("token <> ''")
    n = parts(fields, "field").join(parts(groups, "record"), "token").groupBy("field", "record").agg(F.count("*").alias("score")).filter(F.col("score") >= least)
    return n.groupBy("field").agg(F.min(F.struct((-F.col("score")).alias("s"), "record")).alias("b")).select("field", "b.record", (-F.col("b.s")).alias("score"))


def handover(posts: DataFrame, wants: DataFrame) -> DataFrame:
    """(guard, run_id): for every wanted (guard, field, value) set, the first run whose last state has all its values.

    posts: (run_id, state) with the state as JSON; wants: one row per field of a guard.
    """
    said = posts.select("run_id", F.explode(F.from_json("state", "map<string,string>")).alias("field", "value"))
    need = wants.groupBy("guard").agg(F.count("*").alias("n"))
    met = said.join(wants, ["field", "value"]).groupBy("guard", "run_id").agg(F.count("*").alias("n"))
    return met.join(need, ["guard", "n"]).groupBy("guard").agg(F.min("run_id").alias("run_id"))


def schedules(op: Column, failure: Column, most: int) -> Column:
    """array<array<string>>: k successes, the failure, then success again, for k = 0 .. most."""
    ok = F.lit("00")
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.concat(F.array_repeat(ok, k), F.array(failure), F.array(ok)))


def sampled(seed: str, row: Column, field: Column, pool: Column) -> Column:
    """A value of the pool by a digest of seed, row and field: the same on every run and in any partitioning."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), row, field)), 1, 8), 16, 10).cast("long")
    return F.element_at(pool, (h % F.size(pool)).cast("int") + 1)


def canonical_state(state: Column) -> Column:
    """A map as JSON of its entries in order of their keys: equal states, equal texts."""
    return F.to_json(F.transform(F.array_sort(F.map_entries(state)), lambda e: F.array(e["key"], e["value"])))


def proxy_profile(bindings: DataFrame) -> DataFrame:
    """(slot, injectable, n_values): slots that evidence has set to two different values or more can be injected."""
    return bindings.groupBy("slot").agg(F.count_distinct("value").alias("n_values")).select("slot", (F.col("n_values") >= 2).alias("injectable"), "n_values")


def boundaries(fields: DataFrame) -> DataFrame:
    """(program, field, pos, category, value): values at and beyond the edge of every elementary field's picture.

    fields: (program, field, numeric, width). A picture without digits or letters gives no row.
    """
    nines, over = F.repeat(F.lit("9"), F.col("width")), F.concat(F.lit("1"), F.repeat(F.lit("0"), F.col("width")))
    pair = lambda c, v: F.struct(F.lit(c).alias("category"), v.alias("value"))
    digits = F.array(pair("all-nines", nines), pair("overflow", over), pair("negative-max", F.concat(F.lit("-"), nines)), pair("zero", F.lit("0")))
    letters = F.array(
        pair("width-exact", F.repeat(F.lit("A"), F.col("width"))), pair("over-width", F.repeat(F.lit("A"), F.col("width") + 1)),
        pair("trailing-space", F.concat(F.repeat(F.lit("A"), F.col("width") - 1), F.lit(" "))), pair("spaces", F.repeat(F.lit(" "), F.col("width"))),
    )
    each = F.posexplode(F.when(F.col("numeric"), digits).otherwise(letters)).alias("pos", "v")
    return fields.filter("width > 0").select("program", "field", each).select("program", "field", "pos", "v.category", "v.value")
