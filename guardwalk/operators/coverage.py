"""Directions of decisions over runs: coverage, gaps, ledger, dispositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardwalk.session import Rounds


def observe(events: DataFrame, run: str = "run_id", key: tuple[str, ...] = ("ordinal", "kind"), result: str = "result") -> DataFrame:
    """Directions seen, how many runs saw each, and the first that did."""
    return events.groupBy(*key, F.col(result).alias("direction")).agg(F.countDistinct(run).alias("n_runs"), F.min(run).alias("first_run"))


def decide(df: DataFrame, run: Column, decisions: list[tuple[int, str, Column]]) -> DataFrame:
    """Guard events of every row: one per decision whose Column isn't null (null: not evaluated)."""
    each = F.array(*[F.struct(F.lit(o).alias("ordinal"), F.lit(k).alias("kind"), c.alias("result")) for o, k, c in decisions])
    return df.select(run.alias("run_id"), F.explode(F.filter(each, lambda e: e["result"].isNotNull())).alias("e")).select("run_id", "e.*")


def observe_decisions(df: DataFrame, run: Column, decisions: list[tuple[int, str, Column]]) -> DataFrame:
    """`observe` over `decide`, without its events: one row of flags a run, then one sum per direction."""
    taken = [(o, k, d, F.coalesce(c if d else ~c, F.lit(False))) for o, k, c in decisions for d in (True, False)]
    flags = df.select(run.alias("run_id"), *[c.alias(f"_{i}") for i, (*_, c) in enumerate(taken)])
    runs = flags.groupBy("run_id").agg(*[F.bool_or(f"_{i}").alias(f"_{i}") for i in range(len(taken))])
    sums = runs.agg(*[F.struct(F.count_if(f"_{i}").alias("n"), F.min(F.when(F.col(f"_{i}"), F.col("run_id"))).alias("first")).alias(f"_{i}") for i in range(len(taken))])
    say = lambda i, o, k, d: F.struct(F.lit(o).alias("ordinal"), F.lit(k).alias("kind"), F.lit(d).alias("direction"), F.col(f"_{i}.n").alias("n_runs"), F.col(f"_{i}.first").alias("first_run"))
    each = F.array(*[say(i, o, k, d) for i, (o, k, d, _) in enumerate(taken)])
    return sums.select(F.explode(each).alias("e")).select("e.*").filter("n_runs > 0")


def missing(branches: DataFrame, seen: DataFrame, key: tuple[str, ...] = ("ordinal", "kind")) -> DataFrame:
    """Directions of the branches that no run has taken."""
    both = branches.select(*key).withColumn("direction", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.join(seen.select(*key, "direction"), [*key, "direction"], "left_anti")


def one_way(seen: DataFrame, key: tuple[str, ...] = ("ordinal", "kind")) -> DataFrame:
    return seen.groupBy(*key).agg(F.count_distinct("direction").alias("n"), F.first("direction").alias("only")).filter("n = 1").drop("n")


def first_recipe(credits: DataFrame, key: list[str], recipe: str = "recipe", order: str = "run_seq") -> DataFrame:
    """The recipe that first took each direction."""
    return credits.groupBy(*key).agg(F.min_by(recipe, order).alias(recipe), F.min(order).alias(order))


def unlock(needs: DataFrame, limit: int | None = None) -> list[tuple[str, int]]:
    """Greedy set cover: capabilities in the order they are granted, with the plans unlocked so far; all of them, unless a limit is set.

    needs: (plan, needs array<string>). Plans with the same needs are one row with their number, and meet again as
    granted needs go, so a round's work is bounded by the different sets that are left. The
    driver holds the granted names only. Of equal gains the first name is granted; if none
    gains, the one most plans still need.
    """
    r = Rounds(needs.sparkSession)
    each = needs.groupBy("plan").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("needs")))).alias("needs"))
    left = r.cut(each.groupBy("needs").agg(F.count("*").alias("plans")))
    plans = left.agg(F.sum("plans")).first()[0] or 0
    out: list[tuple[str, int]] = []
    while limit is None or len(out) < limit:
        per = left.select(F.explode("needs").alias("need"), "plans", (F.size("needs") == 1).alias("last")).groupBy("need").agg(F.sum("plans").alias("n"), F.sum(F.when(F.col("last"), F.col("plans")).otherwise(0)).alias("gain"))
        best = per.orderBy(F.desc("gain"), F.when(F.col("gain") > 0, 0).otherwise(-F.col("n")), "need").first()
        if best is None:
            break
        left = r.cut(left.select(F.array_remove("needs", best["need"]).alias("needs"), "plans").groupBy("needs").agg(F.sum("plans").alias("plans")))
        out.append((best["need"], plans - (left.filter(F.size("needs") > 0).agg(F.sum("plans")).first()[0] or 0)))
    r.close()
    return out
