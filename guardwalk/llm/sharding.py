"""Sharding: a Feistel permutation of global row numbers gives shard and slot.

Rows get gapless global numbers 0..n-1, the permutation shuffles the numbers, and
shard and slot are its remainder and quotient by the number of shards. Both can
be computed for any row number alone, and a rerun gives the same places whatever
the partitions are. Law: `rows`, shard counts differ by one at most.

Defined results: a null text has size 8 and the CRC of no bytes; null ids are
numbered like any other; repeated rows get a place each; an empty table gives an
empty plan; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardwalk.llm.feistel import hashed, once, sides, walked

SHARDS = 24
BUCKETS = 4096
SEED = "shuffle-1"
SPLIT = 1 << 16


def number_rows(rows: DataFrame, id_col: str, size_col: str, others: list[str], buckets: int = BUCKETS) -> DataFrame:
    """One row per input row with `row_no` from 0 and `n_rows`, without a sort of all rows.

    Equal rows are counted first; the digest of id and size deals the rest into
    buckets, whose counts (at most `buckets` rows, so they may be broadcast) give
    each bucket its first number.
    """
    keys = [id_col, size_col, *others]
    dealt = rows.select(*keys, F.pmod(hashed(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.col(size_col)), F.lit(buckets)).alias("_b"))
    groups = dealt.repartition("_b").groupBy("_b", *keys).agg(F.count("*").alias("_c"))
    every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.groupBy("_b").agg(F.sum("_c").alias("_c")).select(
        "_b", F.coalesce(F.sum("_c").over(every), F.lit(0)).alias("_from"), F.sum("_c").over(Window.partitionBy()).alias("n_rows")
    )
    before = Window.partitionBy("_b").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("_at", F.coalesce(F.sum("_c").over(before), F.lit(0))).join(F.broadcast(first), "_b")
    parts = placed.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("_c") - 1) / SPLIT).cast("long"))))
    each = parts.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(SPLIT), F.col("_c") - F.col("_p") * SPLIT) - 1)))
    return each.select(*keys, (F.col("_from") + F.col("_at") + F.col("_p") * SPLIT + F.col("_k")).alias("row_no"), "n_rows")


def permute(df: DataFrame, number: str, total: str, seed: str, out: str) -> DataFrame:
    """Add `out`: the number's place in a permutation of 0..total-1 keyed by `seed`."""
    kept = df.columns
    a, b = sides(F.col(total))
    x = df.select(*kept, a.alias("_a"), b.alias("_s"))
    y = x.select(*kept, "_a", "_s", once(F.col(number), F.col("_a"), F.col("_s"), F.lit(seed)).alias("_y"))
    return y.select(*kept, walked(F.col("_y"), F.col(total), F.col("_a"), F.col("_s"), F.lit(seed)).alias(out))


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Shard and slot of every document, with its size in bytes and its text's CRC."""
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    p = permute(number_rows(rows, "doc_id", "size", ["text_crc32"], buckets), "row_no", "n_rows", seed, "place")
    return p.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        ((F.col("place") - F.col("place") % shards) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(shards: int = SHARDS, seed: str = SEED, buckets: int = BUCKETS) -> str:
    """The same plan in DuckDB: numbering, network, walk and CRC."""
    h = lambda *p: "('0x' || substr(md5(concat_ws(':', " + ", ".join(p) + ")), 1, 12))::BIGINT"
    steps, at = [], "n0"
    for i in range(6):
        f = f"((x // b + {h(f"'{seed}'", str(i), 'x % b')}) % a) * b + x % b" if i % 2 == 0 else f"(x // b) * b + (x % b + {h(f"'{seed}'", str(i), 'x // b')}) % b"
        steps.append(f"n{i + 1} AS (SELECT row_no, n, a, b, {f} AS x FROM {at})")
        at = f"n{i + 1}"
    return f"""
WITH RECURSIVE tab AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) r(i)),
tabs AS (SELECT list(v ORDER BY i) AS tb FROM tab),
d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT u, doc_id, (strlen(t) + 8)::BIGINT AS size,
    CASE WHEN t = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(t), '..'), lambda q: ('0x' || q)::BIGINT)),
      lambda c, y: xor(c // 256, tb[xor(c % 256, y) + 1])), 4294967295) END::BIGINT AS text_crc32
  FROM d, tabs),
o AS (SELECT *, {h("coalesce(doc_id::VARCHAR, '-')", "size")} % {buckets} AS bk FROM r),
n AS (SELECT *, row_number() OVER (ORDER BY bk, doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no, count(*) OVER () AS n FROM o),
s AS (SELECT n.row_no, n.n, greatest(1, ceil(sqrt(n.n)))::BIGINT AS a FROM n),
s2 AS (SELECT row_no, n, a, greatest(1, ceil(n / a))::BIGINT AS b FROM s),
walk AS (
  SELECT row_no, n, a, b, row_no AS x, 0 AS k FROM s2
  UNION ALL
  SELECT row_no, n, a, b, y, k + 1 FROM (
    WITH n0 AS (SELECT row_no, n, a, b, x, k FROM walk WHERE k = 0 OR x >= n),
    {", ".join(x.replace("SELECT row_no, n, a, b,", "SELECT row_no, n, a, b, k,") for x in steps)}
    SELECT row_no, n, a, b, k, x AS y FROM n6)),
p AS (SELECT row_no, x AS place FROM walk WHERE k > 0 AND x < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {shards})::INTEGER AS shard, (place // {shards})::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, row_no::BIGINT AS row_no
FROM n JOIN p USING (row_no)
"""


ORACLE = oracle()
