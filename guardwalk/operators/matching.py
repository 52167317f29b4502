"""Matched reads of a master and a transaction file: both in key order, told apart as matched, without transactions, without a master."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardwalk.session import Rounds


def _struct(df: DataFrame, columns: list[str]):
    """A struct of columns, and the null of its type."""
    x = F.struct(*[F.col(f"`{c}`") for c in columns])
    return x, F.lit(None).cast(df.select(x.alias("x")).schema["x"].dataType)


def balance_line(masters: DataFrame, transactions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, side, occurrence, master, transaction): a row per transaction and per master that none matches, as a program that reads both files in key order meets them.

    side: `matched`, `no master`, `no transaction`, `duplicate master`. master and transaction are
    structs of the files' columns, so names may clash. occurrence: a transaction's number from 1
    under its key by `order`, then by all its columns; of masters with one key the least is
    read, the others are duplicates with their number from 2; else null. Null keys match nothing.
    Files have one key column of one type; columns have types with an order.

    Rows go into ranges of (key, file, order), so a hot key's rows lie in as many ranges as their number asks
    for, and no window spans more than one. A key can only lie in several ranges as the least or greatest key
    of each: what ranges tell each other of those is two rows a range at most, which is what is broadcast.
    """
    r = Rounds(masters.sparkSession)
    k = F.col(f"`{key}`")
    m, no_m = _struct(masters, masters.columns)
    t, no_t = _struct(transactions, transactions.columns)
    at, no_at = _struct(transactions, order)
    files = masters.select(k.alias("k"), F.lit(0).alias("file"), no_at.alias("place"), m.alias("m"), no_t.alias("t")).union(transactions.select(k, F.lit(1), at, no_m, t))
    line = ["k", "file", "place", "m", "t"]
    copies = files.filter("k IS NOT NULL").withColumn("copy", F.monotonically_increasing_id())  # lets equal rows lie in more than one range
    rows = r.cut(copies.repartitionByRange(*line, "copy").withColumn("span", F.spark_partition_id()))

    spans = rows.groupBy("span").agg(F.min("k").alias("least"), F.max("k").alias("most")).select("span", F.explode(F.array_distinct(F.array("least", "most"))).alias("k"))
    edges = rows.join(F.broadcast(spans), ["span", "k"]).groupBy("span", "k").agg(F.min("m").alias("m"), F.sum(1 - F.col("file")).alias("ms"), F.sum("file").alias("ts"))
    whole = Window.partitionBy("k")
    before = whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    told = edges.select("span", "k", F.min("m").over(whole).alias("m_all"), F.sum("ts").over(whole).alias("ts_all"), F.sum("ms").over(before).alias("ms_before"), F.sum("ts").over(before).alias("ts_before"))

    here = Window.partitionBy("span", "k")
    seen = rows.select("*", F.min("m").over(here).alias("m_here"), F.sum("file").over(here).alias("ts_here"), F.row_number().over(Window.partitionBy("span", "k", "file").orderBy("place", "m", "t", "copy")).alias("n"))
    x = seen.join(F.broadcast(told), ["span", "k"], "left")
    is_m = F.col("file") == 0
    n = (F.col("n") + F.coalesce(F.when(is_m, F.col("ms_before")).otherwise(F.col("ts_before")), F.lit(0))).cast("long")
    master = F.when(is_m, F.col("m")).otherwise(F.coalesce("m_all", "m_here"))
    x = x.select("k", is_m.alias("is_m"), n.alias("n"), master.alias("master"), "t", F.coalesce("ts_all", "ts_here").alias("ts"))
    side = F.when(F.col("is_m") & (F.col("n") > 1), "duplicate master").when(F.col("is_m"), "no transaction").when(F.col("master").isNull(), "no master").otherwise("matched")
    met = x.select("k", side.alias("side"), "n", "master", "t", "ts").filter("side <> 'no transaction' OR ts = 0")
    lone = files.filter("k IS NULL").select("k", F.when(is_m, "no transaction").otherwise("no master").alias("side"), F.lit(None).cast("long").alias("n"), F.col("m").alias("master"), "t")
    out = met.select("k", "side", F.when(F.col("side") != "no transaction", F.col("n")).alias("n"), "master", "t").union(lone)
    return r.last(out.select(F.col("k").alias(key), "side", F.col("n").alias("occurrence"), "master", F.col("t").alias("transaction")))
