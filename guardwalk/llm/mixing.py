"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source form one line, cut into blocks of equal length. A source's
target gives it a quota of whole blocks; the tree splits all quotas at once among
the output shards, half of a node's shards drawing their blocks from the node's
quotas without return, so every shard gets its exact share and the sources' parts
in it are as random as a full shuffle would make them. A source's draws then run
through a keyed permutation of its blocks, epoch by epoch, and consecutive ranges
of draws go to consecutive shards, as long as the tree says: no two shards draw the
same block of an epoch. Within a shard, `order_key` shuffles (write_mix).

Whole documents (mixed_documents) go through the same tree with documents for blocks: a
source's documents with words are classes by length (to four leading bits), and its target
gives each class a quota of documents, what one class is off being owed to the next. The tree splits the
quotas of all classes and sources at once among the shards; within a class the draws run through a keyed
permutation of its documents, epoch by epoch. So each document is taken its class's share of
times, rounded up or down, and the source's words meet its target as far as lengths within a class are alike.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, the last; null ids and repeated rows are documents like any
other; an empty table gives an empty mix; the driver holds one row per source, and for whole documents
one per class of lengths of it, of which a doubling of lengths has eight; other columns are ignored (draw) or
kept (mixed_documents).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from guardwalk.llm.feistel import hashed
from guardwalk.llm.sharding import permute
from guardwalk.session import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
SEED = "mix-1"
SHARDS = 16
BUCKETS = 4096
#: Cells that documents of like length are dealt over when whole ones are drawn.
CELLS = 256
#: Longest block in words, unless there were more than MOST_BLOCKS of them; sources with fewer than 1024 blocks get
#: shorter ones.
BLOCK = 64
MOST_BLOCKS = 1 << 28
FINEST = 1024
CAP = 3
#: Sources whose plan rows may be broadcast.
BROADCAST_SOURCES = 20_000


@dataclass
class Plan:
    tag: str
    size: int
    target: float
    block: int
    blocks: int
    quota: int
    cuts: list[int]


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its size; the excess is shared again by weight."""
    total, left = float(sum(sizes)), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if total * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in left:
                out[i] = total * weights[i] / w
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        total -= sum(out[i] for i in over)
        left = [i for i in left if i not in set(over)]
    return out


def tree(quotas: list[int], shards: int, seed: str) -> list[list[int]]:
    """Per shard the blocks of each source; shard sizes differ by one at most."""
    out: list[list[int]] = [[] for _ in range(shards)]
    total = sum(quotas)
    upto = [total * i // shards for i in range(shards + 1)]

    def node(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = [int(x) for x in q]
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([lo, hi, *seed.encode()]))
        left = rng.multivariate_hypergeometric(q, upto[mid] - upto[lo], method="marginals")
        node(lo, mid, left)
        node(mid, hi, q - left)

    node(0, shards, np.array(quotas, dtype=np.int64))
    return out


def source_targets(sizes: list[tuple[str, int]], weights: list[float] | None) -> list[float]:
    """Targets in the order of `sizes` (code points, null last); weights 1, 2, 3 repeating unless given."""
    return targets([s for _, s in sizes], weights or [float(i % 3 + 1) for i in range(len(sizes))])


def plan_sources(sizes: list[tuple[str, int]], weights: list[float] | None, shards: int, seed: str) -> list[Plan]:
    """Plans in the order of `sizes`."""
    longest, plans = max(BLOCK, -(-sum(s for _, s in sizes) // MOST_BLOCKS)), []  # the sampler takes less than 10^9 blocks
    for (tag, s), t in zip(sizes, source_targets(sizes, weights), strict=True):
        block = min(longest, max(1, s // FINEST))
        blocks = -(-s // block)
        plans.append(Plan(tag, s, t, block, blocks, min(round(t / block), CAP * blocks), []))
    parts = tree([p.quota for p in plans], shards, seed)
    for i, p in enumerate(plans):
        at, p.cuts = 0, []
        for k in range(shards):
            at += parts[k][i]
            p.cuts.append(at)
    return plans


def word_count(docs: DataFrame, text_col: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(docs[text_col], F.lit("")), SPACE), "")).cast("long")


def tag_of(docs: DataFrame, source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("z"))


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def tally(docs: DataFrame, id_col: str, source_col: str, text_col: str, buckets: int) -> tuple[DataFrame, DataFrame, list[tuple[str, int]]]:
    """(tag, doc_id, size, bucket b of their digest, count c) of the documents, (tag, b, words w), and the sources' lengths."""
    rows = docs.select(docs[id_col].alias("doc_id"), tag_of(docs, source_col).alias("tag"), word_count(docs, text_col).alias("size"))
    rows = rows.withColumn("b", F.pmod(hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size")), F.lit(buckets)))
    groups = rows.groupBy("tag", "b", "doc_id", "size").agg(F.count("*").alias("c"))
    checkpoint_dir(docs.sparkSession)
    groups = groups.checkpoint()  # ids and counts only; the texts are read once
    per = groups.groupBy("tag", "b").agg(F.sum(F.col("size") * F.col("c")).alias("w"))
    sizes = per.groupBy("tag").agg(F.sum("w").alias("w")).collect()
    order = sorted(((r["tag"], int(r["w"] or 0)) for r in sizes), key=lambda x: (x[0] == "z", x[0].encode("utf-8", "surrogatepass")))
    return groups, per, order


def lay_out(docs: DataFrame, id_col: str, source_col: str, text_col: str, buckets: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Every document's words [from, from + size) on its source's line, and the sources' lengths.

    Sums per source and bucket (of the digest of id and size) give the buckets their
    places, sums within a bucket the documents theirs; a hot source spreads over all
    its buckets.
    """
    groups, per, order = tally(docs, id_col, source_col, text_col, buckets)
    place = per.select("tag", "b", F.coalesce(F.sum("w").over(before(Window.partitionBy("tag").orderBy("b"))), F.lit(0)).alias("at"))
    inner = F.sum(F.col("size") * F.col("c")).over(before(Window.partitionBy("tag", "b").orderBy(F.col("doc_id").asc_nulls_first(), "size")))
    laid = groups.withColumn("in", F.coalesce(inner, F.lit(0))).join(place, ["tag", "b"])
    copies = laid.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    return copies.select("doc_id", "tag", "size", "copy", (F.col("at") + F.col("in") + F.col("copy") * F.col("size")).alias("from")), order


def draw(docs: DataFrame, weights: list[float] | None = None, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per document and block it has words in (one with a null block for empty documents).

    doc_id, tag, size, copy, source_size, target; block, first_word and words (the
    document's words in the block), place (the block's in the permutation), and in
    `taken_by` every draw of the mix with its epoch, shard and order_key.
    """
    spark = docs.sparkSession
    laid, sizes = lay_out(docs, id_col, source_col, text_col, buckets)
    plans = plan_sources(sizes, weights, shards, seed)
    fields = "tag string, source_size long, target double, block_words long, n_blocks long, quota long, cuts array<long>"
    p = spark.createDataFrame([(x.tag, x.size, x.target, x.block, x.blocks, x.quota, x.cuts) for x in plans], fields)
    j = laid.join(F.broadcast(p) if len(plans) <= BROADCAST_SOURCES else p, "tag")
    first, last = F.floor(F.col("from") / F.col("block_words")), F.floor((F.col("from") + F.col("size") - 1) / F.col("block_words"))
    a = j.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    lo = F.greatest(F.col("from"), F.col("block") * F.col("block_words"))
    hi = F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    b = a.withColumn("first_word", lo - F.col("from")).withColumn("words", hi - lo)
    c = permute(b, "block", "n_blocks", seed, "place")
    at = lambda epoch: epoch * F.col("n_blocks") + F.col("place")
    # the line of draws ends where the tree's last shard does
    epochs = F.filter(F.array(*[F.lit(e).cast("long") for e in range(CAP)]), lambda e: at(e) < F.element_at("cuts", -1))
    by = F.transform(epochs, lambda e: F.struct(e.alias("epoch"), F.size(F.filter("cuts", lambda x: x <= at(e))).alias("shard"), hashed(F.lit(seed), F.lit("order"), F.col("tag"), at(e)).alias("order_key")))
    taken_by = F.when(F.col("block").isNotNull(), by).otherwise(F.slice(by, 1, 0))
    return c.select("doc_id", "tag", "size", "copy", "source_size", "target", "block", "first_word", "words", "place", taken_by.alias("taken_by"))


def taken_words(drawn: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document the words the mix takes, repeats counted, and how many of them each shard takes (shard:words)."""
    words = F.coalesce(F.col("words"), F.lit(0))
    times = lambda k: F.size(F.filter("taken_by", lambda d: d["shard"] == k))
    in_shard = [F.sum(words * times(k)).alias(f"_{k}") for k in range(shards)]
    g = drawn.groupBy("doc_id", "tag", "size", "copy").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), *in_shard)
    named = F.array(*[F.when(F.col(f"_{k}") > 0, F.concat_ws(":", F.lit(str(k)), F.col(f"_{k}").cast("string"))) for k in range(shards)])
    taken = reduce(Column.__add__, [F.col(f"_{k}") for k in range(shards)])
    return g.select(
        "doc_id", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", taken.cast("long").alias("taken"),
        F.array_join(F.array_compact(named), ",").alias("shard_words"),
    )


def write_mix(drawn: DataFrame, path: str, parts: int = 1) -> None:
    """The mix as Parquet, a folder per shard: the drawn pieces of documents in the order of their keys, in `parts` ranges of keys."""
    each = drawn.select("doc_id", "tag", "copy", "block", "first_word", "words", F.explode("taken_by").alias("d"))
    rows = each.select("doc_id", "tag", "copy", "block", "first_word", "words", "d.epoch", "d.shard", "d.order_key")
    part = F.floor(F.col("order_key") / F.lit(-(-(1 << 48) // parts))).cast("int")
    rows.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "part", "order_key", "epoch", "first_word").write.partitionBy("shard", "part").parquet(path)


def document_quotas(classes: list[tuple[int, int]], ratio: float) -> list[int]:
    """How many draws each class of (documents, words) gets for ratio times its words, in their order; what one is off is owed to the next."""
    out, owed = [], 0.0
    for n, words in classes:
        owed += ratio * words
        out.append(max(0, min(round(owed * n / words), CAP * n)))
        owed -= out[-1] * words / n
    return out


def whole_draws(groups: DataFrame, ratios: dict[str, float], shards: int, seed: str) -> DataFrame:
    """(doc_id, tag, size, c, copy, taken_by): every draw of each of the c documents of an id, source and length, with its epoch, shard and order_key."""
    shift = "greatest(length(bin(size)) - 4, 0)"
    g = groups.filter("size > 0").withColumn("about", F.expr(f"shiftleft(shiftright(size, {shift}), {shift})")).withColumn("cell", F.col("b") % CELLS)
    per = g.groupBy("tag", "about", "cell").agg(F.sum("c").alias("n"), F.sum(F.col("size") * F.col("c")).alias("w"))
    classes = per.groupBy("tag", "about").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).orderBy("tag", F.desc("about")).collect()
    quotas: list[int] = []
    for tag in dict.fromkeys(r["tag"] for r in classes):  # the longest first, so that the shortest settle what is owed
        quotas += document_quotas([(int(r["n"]), int(r["w"])) for r in classes if r["tag"] == tag], ratios[tag])
    unit = max(1, -(-sum(quotas) // MOST_BLOCKS))  # the sampler takes less than 10^9 draws; what is over goes to the last shard
    cuts = np.cumsum(np.array(tree([q // unit for q in quotas], shards, seed), dtype=np.int64).reshape(shards, -1), axis=0) * unit
    cuts[-1] = quotas
    plans = [(r["tag"], r["about"], int(r["n"]), q, [int(x) for x in cuts[:, i]]) for i, (r, q) in enumerate(zip(classes, quotas, strict=True))]
    p = groups.sparkSession.createDataFrame(plans, "tag string, about long, n_docs long, quota long, cuts array<long>")
    place = per.select("tag", "about", "cell", F.coalesce(F.sum("n").over(before(Window.partitionBy("tag", "about").orderBy("cell"))), F.lit(0)).alias("at"))
    inner = F.sum("c").over(before(Window.partitionBy("tag", "about", "cell").orderBy("size", F.col("doc_id").asc_nulls_first())))
    j = g.withColumn("in", F.coalesce(inner, F.lit(0))).join(place, ["tag", "about", "cell"]).join(F.broadcast(p) if len(plans) <= BROADCAST_SOURCES else p, ["tag", "about"])
    copies = j.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    d = permute(copies.withColumn("number", F.col("at") + F.col("in") + F.col("copy")), "number", "n_docs", seed, "place")
    at = lambda epoch: epoch * F.col("n_docs") + F.col("place")
    epochs = F.filter(F.array(*[F.lit(e).cast("long") for e in range(CAP)]), lambda e: at(e) < F.col("quota"))
    by = F.transform(epochs, lambda e: F.struct(e.alias("epoch"), F.size(F.filter("cuts", lambda x: x <= at(e))).alias("shard"), hashed(F.lit(seed), F.lit("whole"), F.col("tag"), F.col("about"), at(e)).alias("order_key")))
    # the first epoch's draw, not the list of draws, tells whether there is one: Spark moves the condition down and would walk the permutation once for every use in it
    return d.filter(F.col("place") < F.col("quota")).select("doc_id", "tag", "size", "c", "copy", by.alias("taken_by"))


def mixed_documents(docs: DataFrame, weights: list[float] | None = None, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Whole documents with all their columns, none, one or several rows of each, so that every source's words meet its target; shards stay together, in the order of their keys."""
    groups, _, sizes = tally(docs, id_col, source_col, text_col, buckets)
    ratios = {tag: t / s for (tag, s), t in zip(sizes, source_targets(sizes, weights), strict=True) if s}
    per = whole_draws(groups, ratios, shards, seed).checkpoint()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"), tag_of(docs, source_col).alias("_tag"), word_count(docs, text_col).alias("_size"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tag") == F.col("tag")) & (F.col("_size") == F.col("size"))
    out = rows.join(per.filter("c = 1").hint("shuffle_hash"), same).select("_row", "taken_by")
    several = per.filter("c > 1")
    if not several.isEmpty():  # repeated ids: the n-th of their rows is the n-th copy
        by = [F.col("_row")[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        nth = F.row_number().over(Window.partitionBy("_id", "_tag", "_size").orderBy(*by)) - 1
        alike = rows.join(several.select("doc_id", "tag", "size").distinct(), same, "left_semi").withColumn("_nth", nth)
        out = out.unionByName(alike.join(several, same & (F.col("_nth") == F.col("copy"))).select("_row", "taken_by"))
    each = out.select("_row", F.explode("taken_by").alias("_d")).select("_row", F.col("_d.shard").alias("_shard"), F.col("_d.order_key").alias("_order"))
    part = F.shiftright("_order", 42)  # 64 ranges of keys a shard
    return each.withColumn("_part", part).repartition("_shard", "_part").sortWithinPartitions("_shard", "_part", "_order").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return taken_words(draw(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def taken_query(spark, sf_dir: str) -> DataFrame:
    """The same result without its words by shard, which have no SQL."""
    return query(spark, sf_dir).drop("shard_words")


def sql(seed: str = SEED, buckets: int = BUCKETS) -> str:
    """The mix without its shards in DuckDB: targets by filling up, lines of words, permuted blocks. The tree's draws have no SQL."""
    h = lambda *p: "('0x' || substr(md5(concat_ws(':', " + ", ".join(p) + ")), 1, 12))::BIGINT"
    steps = []
    for i in range(6):
        f = f"((x // b + {h(f"'{seed}'", str(i), 'x % b')}) % a) * b + x % b" if i % 2 == 0 else f"(x // b) * b + (x % b + {h(f"'{seed}'", str(i), 'x // b')}) % b"
        steps.append(f"n{i + 1} AS (SELECT block, tag, n, a, b, k, {f} AS x FROM n{i})")
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS u, doc_id, coalesce('s' || source, 'z') AS tag,
  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
e AS (SELECT *, {h("coalesce(doc_id::VARCHAR, '-')", "size")} % {buckets} AS bk FROM d),
l AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY tag ORDER BY bk, doc_id NULLS FIRST, size, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS fr FROM e),
s AS (SELECT tag, sum(size)::BIGINT AS sz, (row_number() OVER (ORDER BY tag = 'z', tag) - 1) % 3 + 1 AS w FROM d GROUP BY tag),
c AS (SELECT *, {CAP} * sz / w AS ratio, row_number() OVER o AS rn, sum({CAP} * sz) OVER o - {CAP} * sz AS full_before,
  sum(w) OVER () - sum(w) OVER o + w AS open_weight, sum(sz) OVER () AS total FROM s
  WINDOW o AS (ORDER BY {CAP} * sz / w, tag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT coalesce((SELECT arg_min((total - full_before) / open_weight, rn) FROM c WHERE (total - full_before) / open_weight <= ratio), 0) AS level),
t AS (SELECT tag, sz, least({CAP} * sz, w * level)::DOUBLE AS target, least(greatest({BLOCK}, (SELECT (sum(sz) + {MOST_BLOCKS} - 1) // {MOST_BLOCKS} FROM s))::BIGINT, greatest(1, sz // {FINEST})) AS bw FROM s, m),
t2 AS (SELECT *, (sz + bw - 1) // bw AS n, least(round_even(target / bw, 0)::BIGINT, {CAP} * ((sz + bw - 1) // bw)) AS quota FROM t),
bl AS (SELECT l.u, l.doc_id, l.size, t2.*, l.fr, unnest(range(l.fr // bw, (l.fr + l.size - 1) // bw + 1)) AS block FROM l JOIN t2 USING (tag) WHERE l.size > 0),
s0 AS (SELECT DISTINCT tag, block, n, greatest(1, ceil(sqrt(n)))::BIGINT AS a FROM bl),
walk AS (
  SELECT block, tag, n, a, greatest(1, ceil(n / a))::BIGINT AS b, block AS x, 0 AS k FROM s0
  UNION ALL
  SELECT block, tag, n, a, b, y, k + 1 FROM (
    WITH n0 AS (SELECT block, tag, n, a, b, k, x FROM walk WHERE k = 0 OR x >= n), {", ".join(steps)}
    SELECT block, tag, n, a, b, k, x AS y FROM n6)),
p AS (SELECT tag, block, x AS place FROM walk WHERE k > 0 AND x < n),
g AS (SELECT u, sum((least(fr + size, (block + 1) * bw) - greatest(fr, block * bw)) * (quota // n + CASE WHEN place < quota % n THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM bl JOIN p USING (tag, block) GROUP BY u)
SELECT l.doc_id, l.size, t2.sz AS source_size, t2.target, coalesce(g.taken, 0) AS taken FROM l JOIN t2 USING (tag) LEFT JOIN g USING (u)
"""
