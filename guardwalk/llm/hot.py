"""A join to per-group facts that stays even when one group holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group is hot from one in so many rows on; there are at most so many hot groups, which bounds the broadcast.
HOT_SHARE = 1000


def is_hot(count: str, total: int) -> Column:
    return F.col(count) * HOT_SHARE >= max(total, HOT_SHARE * 8)


def join_facts(rows: DataFrame, key: str, spread: list[Column], facts: DataFrame, count: str, total: int, drop_when_hot: dict[str, Column] | None = None, small: Column | None = None) -> DataFrame:
    """Left join `facts` (one row per `key`, with its group's size in `count`) to `rows`.

    Groups of total / HOT_SHARE rows or more are at most HOT_SHARE, so their facts
    are broadcast; their rows then take a key of their own (from `spread`) in the
    shuffle that joins the rest, and don't meet in one task. `drop_when_hot` replaces
    columns of hot rows before that shuffle, in terms of the facts' columns. Facts that
    aren't `small` aren't broadcast; Spark splits their rows where they are skewed, for
    which both sides need a shuffle of their own. Otherwise hot rows' keys are of the key's
    type, so that facts which come from a grouping by the key stay where they are.
    """
    kinds = {dict(rows.dtypes)[key], dict(facts.dtypes)[key]}
    facts = facts.withColumnRenamed(key, "_k")
    names = [c for c in facts.columns if c != "_k"]
    large = is_hot(count, total) if small is None else is_hot(count, total) & small
    hot = facts.filter(large).select("_k", *[F.col(c).alias(f"_h_{c}") for c in names])
    a = rows.join(F.broadcast(hot), F.col(key) == F.col("_k"), "left")
    met = F.col("_k").isNotNull()
    kept = [F.coalesce((drop_when_hot or {}).get(c, F.col(c)), F.lit(None)).alias(c) if c in (drop_when_hot or {}) else F.col(c) for c in rows.columns]
    own = F.concat_ws(":", F.lit("hot"), *[c.cast("string") for c in spread])
    apart = {"binary": F.unhex(F.md5(own)), "bigint": F.xxhash64(own), "string": F.md5(own)}
    kind = kinds.pop() if small is None and len(kinds) == 1 else ""
    typed = (lambda c: F.col(c)) if kind in apart else (lambda c: F.col(c).cast("string"))
    b = a.select(*kept, *[f"_h_{c}" for c in names], met.alias("_met"), F.when(met, apart.get(kind, apart["string"])).otherwise(typed(key)).alias("_j"))
    cold = facts.filter(~large).select(typed("_k").alias("_c"), *[F.col(c).alias(f"_c_{c}") for c in names])
    c = b.join(cold.hint("shuffle_hash"), F.col("_j") == F.col("_c"), "left")
    return c.select(*rows.columns, *[F.when(F.col("_met"), F.col(f"_h_{x}")).otherwise(F.col(f"_c_{x}")).alias(x) for x in names])
