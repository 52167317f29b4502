"""The longest stored chain that another chain starts with: a binary search over prefix lengths, a round of equi-joins per bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardwalk.session import Rounds


def _digest(chain, n):
    """Names the first n items; the JSON text tells nulls, empty items and borders of items apart."""
    return F.sha2(F.to_json(F.slice(chain, 1, n)), 256)


def _step(rows: DataFrame, level: DataFrame, bit: int) -> DataFrame:
    """One round: a chain whose first p + 2^bit items are a mark moves there, and takes the mark's answer if it has one."""
    to = F.col("p") + F.lit(1 << bit)
    beyond = F.concat(F.lit("-"), F.xxhash64("c").cast("string"))  # such rows meet nothing; keys of their own keep them from one partition
    asked = rows.withColumn("k", F.when(to <= F.size("c"), _digest(F.col("c"), to)).otherwise(beyond))
    met = asked.join(level.select(F.col("key").alias("k"), F.lit(True).alias("hit"), F.col("answer").alias("new")), "k", "left")
    return met.withColumn("p", F.when(F.col("hit"), to).otherwise(F.col("p"))).withColumn("answer", F.coalesce("new", "answer")).drop("k", "hit", "new")


def longest_prefix(chains: DataFrame, chain: str, stored: DataFrame, stored_chain: str, verified: str, order: list[str]) -> DataFrame:
    """(asked, stored, length): a row per row of `chains`, with the stored row whose chain is its longest prefix, or nulls.

    Of stored rows with equal chains a verified one stands, then the least by `order`, then by all its columns. asked
    and stored are structs of the tables' columns, so names may clash. Chains are arrays of strings; null
    items equal null items. An empty stored chain is a prefix of every chain. A null chain has no prefix and is none.

    A stored chain of length 13 (1101) leaves marks at 8, 12 and 13 items, one per set bit. A chain asks at 8,
    then at 4, 2 and 1 beyond where it is, and moves on where it meets a mark. A mark that isn't stored itself may
    lead past the answer, so it carries it: the longest stored chain between the mark before it and itself, found by
    the same search over marks of lower bits, which are ready by then. Rows: marks, at most log n a
    stored chain, and different chains; none per prefix. A round is an equi-join with a table of unique keys; where very many
    chains start alike, the many lie on the side that adaptive execution splits.
    """
    r = Rounds(chains.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in stored.columns])
    rank = F.struct((~F.coalesce(F.col(f"`{verified}`"), F.lit(False))).alias("a"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("b"), whole.alias("c"))
    s = stored.select(F.col(f"`{stored_chain}`").cast("array<string>").alias("c"), whole.alias("row"), rank.alias("rank")).filter("c IS NOT NULL")
    best = r.cut(s.groupBy("c").agg(F.min_by("row", "rank").alias("row")).withColumn("n", F.size("c")))
    bits = (best.agg(F.max("n")).first()[0] or 0).bit_length()

    low = F.explode(F.filter(F.sequence(F.lit(0), F.lit(max(bits - 1, 0))), lambda j: F.expr("n").bitwiseAND(F.call_function("shiftleft", F.lit(1), j)) != 0))
    marks = best.filter("n > 0").select("*", low.alias("low")).withColumn("p", F.expr("shiftleft(shiftright(n, low), low)"))
    marks = marks.select(F.slice("c", 1, F.col("p")).alias("c"), "low", "p", F.when(F.col("p") == F.col("n"), F.col("row")).alias("answer"))
    marks = marks.withColumn("key", _digest(F.col("c"), F.col("p")))
    marks = r.cut(marks.groupBy("key").agg(F.first("c").alias("c"), F.first("low").alias("low"), F.first("p").alias("p"), F.first("answer", True).alias("answer")))

    levels: list[DataFrame] = []
    for bit in range(bits):
        here = marks.filter(F.col("low") == bit)
        ready = here.filter("answer IS NOT NULL").select("key", "answer")
        if bit:
            open_ = here.filter("answer IS NULL").withColumn("p", F.col("p") - F.lit(1 << bit))
            for lower in range(bit - 1, -1, -1):
                open_ = _step(open_, levels[lower], lower)
            ready = r.cut(ready.union(open_.select("key", "answer")))
        levels.append(ready)

    asked = F.struct(*[F.col(f"`{c}`") for c in chains.columns])
    rows = chains.select(asked.alias("asked"), F.col(f"`{chain}`").cast("array<string>").alias("c"))
    none = best.filter("n = 0").select(F.lit(0).alias("p"), F.col("row").alias("answer"))  # a row at most
    found = rows.select("c").filter("c IS NOT NULL").distinct().withColumn("p", F.lit(0)).join(F.broadcast(none), "p", "left")
    for bit in range(bits - 1, -1, -1):
        found = _step(found, levels[bit], bit)
    out = rows.join(found.select("c", "answer"), "c", "left")
    return r.last(out.select("asked", F.col("answer").alias("stored"), F.when(F.col("answer").isNotNull(), F.size(F.col("answer")[stored_chain])).cast("long").alias("length")))
