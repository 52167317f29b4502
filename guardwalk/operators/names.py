"""Qualified names: which field `A OF B OF C` means in a hierarchy of fields, and which references mean the same field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardwalk.session import Rounds


def parts(text):
    """[A, B, C] of `a of B in C`, in upper case; a null text has none."""
    return F.split(F.upper(F.trim(text)), r"\s+(?:OF|IN)\s+")


def paths(fields: DataFrame, rounds: Rounds) -> DataFrame:
    """(id, name, above) of (id, parent, name): the names above a field from the nearest to the top, in rounds that double what is known.

    A parent that is no field is taken for none. A field among its own parents is an error.
    """
    x = rounds.cut(fields.select("id", F.upper("name").alias("name"), F.col("parent").alias("next")))
    up = x.select(F.col("id").alias("next"), F.array("name").alias("more"), F.col("next").alias("after"))
    out = rounds.cut(x.withColumn("above", F.array().cast("array<string>")))
    n, length = x.count(), 1
    while out.filter("next IS NOT NULL").limit(1).count():
        if length > 2 * n:
            raise ValueError("a field is among its own parents")
        lone = out.filter("next IS NULL")  # these are whole, and null keys would meet in one partition
        out = rounds.cut(out.filter("next IS NOT NULL").join(up, "next", "left").select("id", "name", F.col("after").alias("next"), F.concat("above", F.coalesce("more", F.array().cast("array<string>"))).alias("above")).union(lone.select("id", "name", "next", "above")))
        u = up.filter("after IS NOT NULL").join(up.select(F.col("next").alias("after"), F.col("more").alias("more2"), F.col("after").alias("after2")), "after", "left")
        up = rounds.cut(u.select("next", F.concat("more", F.coalesce("more2", F.array().cast("array<string>"))).alias("more"), F.col("after2").alias("after")).union(up.filter("after IS NULL")))
        length *= 2
    return out.select("id", "name", "above")


def _within(path, above):
    """Whether the qualifiers of a path stand in this order, others between them allowed, in the names above."""
    at = F.aggregate(above, F.lit(1), lambda k, x: F.when(F.get(path, k) == x, k + 1).otherwise(k))
    return at == F.size(path)


def resolve(references: DataFrame, path: str, fields: DataFrame) -> DataFrame:
    """(reference, status, field, matches): a row per reference, whose `path` is an array [name, qualifier, ...].

    A field is meant if its name is the path's first and the path's others stand above it in this order, with or without
    others between. status: `resolved` (field is its id), `ambiguous`, `unknown`; matches tells how many are meant.
    reference is a struct of the reference's columns. Null or empty paths, and paths with a null, are unknown. Fields: (id, parent, name), unique ids.

    The index holds a row per (name, one name above it), with how many fields have it: a path with
    no qualifier or one is answered by that row. A longer path goes to the fields of its rarest (name, qualifier) only, as different paths against
    different paths, and only counts leave that join.
    """
    r = Rounds(references.sparkSession)
    declared = paths(fields.select("id", "parent", "name"), r).groupBy("name", "above").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    declared = r.cut(declared.filter("name IS NOT NULL"))
    each = declared.select("name", "n", "id", F.explode(F.array_union(F.array(F.lit(None).cast("string")), F.array_distinct("above"))).alias("q"))
    index = r.cut(each.groupBy("name", F.coalesce(F.concat(F.lit("="), "q"), F.lit("")).alias("q")).agg(F.sum("n").alias("n"), F.min("id").alias("id")))

    rows = references.select(F.struct(*[F.col(f"`{c}`") for c in references.columns]).alias("reference"), F.transform(F.col(f"`{path}`"), F.upper).alias("path"))
    asked = rows.select("path").distinct().filter("size(path) > 0 AND NOT exists(path, x -> x IS NULL)")
    keys = asked.select("path", F.col("path")[0].alias("name"), F.explode(F.when(F.size("path") == 1, F.array(F.lit(""))).otherwise(F.transform(F.array_distinct(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(1)))), lambda q: F.concat(F.lit("="), q)))).alias("q"))
    counted = keys.join(index, ["name", "q"], "left").groupBy("path").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "q", "id")).alias("rarest"))
    counted = r.cut(counted.select("path", "rarest.*"))
    done = counted.filter("n = 0 OR size(path) <= 2").select("path", "n", "id")
    long = counted.filter("n > 0 AND size(path) > 2").select("path", F.col("path")[0].alias("name"), "q")
    at = declared.select("name", "above", F.col("n").alias("m"), F.col("id").alias("one"), F.explode(F.array_distinct("above")).alias("q0")).withColumn("q", F.concat(F.lit("="), "q0"))
    met = long.join(at, ["name", "q"]).filter(_within(F.col("path"), F.col("above"))).groupBy("path").agg(F.sum("m").alias("n"), F.min("one").alias("id"))
    out = rows.join(done.union(met), "path", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    status = F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return r.last(out.select("reference", status.alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("field"), F.col("n").alias("matches")))


def merged(resolved: DataFrame, path: str) -> DataFrame:
    """(field, spellings, uses) of resolved references: how often each field is meant, however it is spelled."""
    by = resolved.filter("status = 'resolved'").groupBy("field", F.transform(F.col(f"reference.`{path}`"), F.upper).alias("p")).agg(F.count("*").alias("n"))
    return by.groupBy("field").agg(F.count("*").alias("spellings"), F.sum("n").alias("uses"))
