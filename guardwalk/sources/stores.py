"""Sources and sinks beside a program: witness ledger, journal, work lists, capability profiles, fixed-width records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WITNESS = "paragraph string, ordinal int, kind string, direction boolean, recipe string, run_seq long"
PROFILE = "version string, name string, operations array<struct<op:string,aliases:array<string>,fields:array<string>>>, injectable array<string>, replayable array<string>"
JOURNAL = "seq long, kind string, slot string, value string, note string"
KEY = ["paragraph", "ordinal", "kind", "direction"]


def write_witnesses(ledger: DataFrame, path: str) -> None:
    """JSON lines by key. A global order of the files comes from a range partitioning, not from one task."""
    ledger.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.mode("overwrite").json(path)


def read_witnesses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WITNESS).json(path)


def credit(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """The ledger with new witnesses: the first recipe of a direction stays."""
    both = ledger.select(*KEY, "recipe", "run_seq").unionByName(fresh.select(*KEY, "recipe", "run_seq"))
    return both.groupBy(*KEY).agg(F.min_by("recipe", "run_seq").alias("recipe"), F.min("run_seq").alias("run_seq"))


def append_journal(entries: DataFrame, path: str) -> None:
    entries.select("seq", "kind", "slot", "value", "note").write.mode("append").json(path)


def journal_bindings(spark: SparkSession, path: str) -> DataFrame:
    """Agent bindings, the latest of each slot."""
    j = spark.read.schema(JOURNAL).json(path).filter("kind = 'bind'")
    return j.groupBy("slot").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def read_profile(spark: SparkSession, path: str, major: str = "1") -> DataFrame:
    """Capability profiles of the supported major version, a row per operation; unknown keys are ignored."""
    p = spark.read.schema(PROFILE).option("multiLine", True).json(path).filter(F.split("version", r"\.")[0] == major)
    return p.select("name", "injectable", "replayable", F.explode_outer("operations").alias("o")).select("name", "injectable", "replayable", "o.op", "o.aliases", "o.fields")


def canonical(op):
    """An operation's name in one punctuation."""
    return F.regexp_replace(F.regexp_replace(F.upper(op), "[^A-Z0-9]+", ":"), "^:|:$", "")


def resolve_operations(calls: DataFrame, profile: DataFrame) -> DataFrame:
    """(op, found, tier): exact name, then canonical punctuation, then alias; the earlier tier wins."""
    exact = profile.select(F.col("op").alias("x"), F.col("op").alias("f1")).distinct()
    canon = profile.groupBy(canonical(F.col("op")).alias("y")).agg(F.min("op").alias("f2"))
    alias = profile.select(F.explode_outer("aliases").alias("a"), "op").groupBy(canonical(F.col("a")).alias("z")).agg(F.min("op").alias("f3"))
    j = calls.select("op").distinct().join(exact, F.col("op") == F.col("x"), "left").join(canon, canonical(F.col("op")) == F.col("y"), "left").join(alias, canonical(F.col("op")) == F.col("z"), "left")
    tier = F.when(F.col("f1").isNotNull(), "exact").when(F.col("f2").isNotNull(), "canonical").when(F.col("f3").isNotNull(), "alias").otherwise("none")
    return j.select("op", F.coalesce("f1", "f2", "f3").alias("found"), tier.alias("tier"))


def unrepresentable(bindings: DataFrame, profile: DataFrame) -> DataFrame:
    """(plan, slot, reason) of bindings that the harness refuses: unknown operation or a field it can't set.

    bindings: (plan, slot, op, field); op null means entry state.
    """
    ops = profile.select(F.col("op").alias("p_op"), "fields").dropDuplicates(["p_op"])
    entry = profile.select(F.explode("injectable").alias("p_field")).distinct()
    j = bindings.join(ops, F.col("op") == F.col("p_op"), "left").join(entry, (F.col("field") == F.col("p_field")) & F.col("op").isNull(), "left")
    reason = (
        F.when(F.col("op").isNull() & F.col("p_field").isNull(), F.concat(F.lit("not injectable: "), "field"))
        .when(F.col("op").isNotNull() & F.col("p_op").isNull(), F.concat(F.lit("unknown operation: "), "op"))
        .when(F.col("op").isNotNull() & ~F.array_contains("fields", F.col("field")), F.concat(F.lit("field not offered: "), "field"))
    )
    return j.select("plan", "slot", reason.alias("reason")).filter("reason IS NOT NULL")
