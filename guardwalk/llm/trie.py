"""Prefix trie of conversations with subtree totals by a depth-band rollup.

A node is a distinct sequence of first turns (role, text). Its key is a digest of its
depth and of four sums of hashed (place, turn) pairs along the sequence, so a prefix's
key is a running sum: no conversation is held in one piece, and a node's parent key is
its own sums less its last turn's. Long conversations are numbered and summed in blocks
of BLOCK turns, whose totals are then added up, so that none meets in one task whole.

Subtree totals go by bands of `height` levels. A node explodes to its ancestors within
its own band only, which gives every node the totals of its band. Band roots (depths
that `height` divides) then form a trie `height` times lower; going up one band a
round, each adds its completed total to the band root above. At the end a completed
band root is exploded once to its parent's ancestors in the band above. Explosion is
at most `height` rows a node and rounds are depth / height; `height` is the power of two
from the square root of the greatest depth on (16 at least), which bounds both alike.

Conversations that end at a node are concatenated in numerical order in pieces of one
range of ids, then the pieces of a node are hashed in order as a stream: only a node
that holds several pieces needs Python, a task holds one piece at a time.

Defined results: turns stand in the order of their number, nulls first, then of their
digest (MD5 of role's length, role and text), which also orders repeated rows; a null
role or text is empty; rows without conv_id belong to no conversation and are left out;
an empty table has no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardwalk.llm.hot import join_facts
from guardwalk.llm.neardup import Tables

#: Turns of a conversation that are numbered, summed and windowed together; heights divide it.
BLOCK = 1024
#: Ids of a range whose decimals are concatenated at once.
RANGE = 1024
HEADS, GROUP = 8, 5
LANES = 4


def turns_of(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, digest, n_bytes) without the texts."""
    who, said = F.coalesce(conversations[role], F.lit("")), F.coalesce(conversations[text], F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)))
    rows = conversations.filter(conversations[conv].isNotNull())
    return rows.select(conversations[conv].cast("long").alias("conv_id"), conversations[turn].cast("long").alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("n_bytes"))


def ranked(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, n_bytes): places from 1, counted in blocks of turn numbers."""
    t = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "digest")
    local = t.withColumn("at", F.row_number().over(inside))
    counts = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # only later blocks of long conversations have turns before them
    late = counts.withColumn("before", F.sum("n").over(before)).filter("before > 0").select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "before")
    met = local.join(late, (F.col("conv_id") == F.col("_c")) & F.col("block").eqNullSafe(F.col("_b")), "left")
    return met.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "n_bytes")


def branched(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: ((conv_id, place, digest, n_bytes, length), (conv_id, length)).

    Of (conv_id, place, ...): the first h turns of conversation c - c % GROUP, then c's own
    turns after its first h, with h = crc32(decimal c) % (HEADS + 1).
    """
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    named = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)).alias("h"))
    bases = sizes.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    own_base = F.col("conv_id") == F.col("base")
    facts = named.join(bases, "base", "left").select(
        "conv_id", "base", F.when(own_base, 0).otherwise(F.col("h")).alias("h"), F.when(own_base, 0).otherwise(taken).alias("taken"), "n"
    ).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = rows.join(facts, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "n_bytes", "length")
    heads = rows.filter((F.col("place") <= HEADS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    first = facts.filter("taken > 0").join(heads, "base").filter("place <= taken").select("conv_id", "place", "digest", "n_bytes", "length")
    return own.union(first), facts.select("conv_id", "length")


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[x.cast("string") for x in lanes])))


ROOT = hashlib.md5(b"0" + b":0" * LANES).digest()


def prefixes(rebuilt: DataFrame, height: int) -> DataFrame:
    """(key, conv_id, depth, parent, n_bytes, above, ends) of every first part of a conversation.

    `above` are the keys from the band's root down to the node's own. Sums are of 31
    bits a turn, which 64 bits hold for 2^32 turns.
    """
    hashed = [F.xxhash64(F.lit(k), "place", "digest") for k in range(LANES // 2)]
    lanes = [x for h in hashed for x in (h.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(h, 33))]
    t = rebuilt.select("*", F.floor(F.col("place") / BLOCK).alias("block"), *[x.alias(f"l{i}") for i, x in enumerate(lanes)])
    w = Window.partitionBy("conv_id", "block").orderBy("place")
    local = t.select("*", *[F.sum(f"l{i}").over(w).alias(f"s{i}") for i in range(LANES)])
    blocks = t.groupBy("conv_id", "block").agg(*[F.sum(f"l{i}").alias(f"b{i}") for i in range(LANES)])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    late = blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *[F.sum(f"b{i}").over(before).alias(f"b{i}") for i in range(LANES)]).filter("_b > 0")
    met = local.join(late, (F.col("conv_id") == F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    whole = [F.col(f"s{i}") + F.coalesce(f"b{i}", F.lit(0)) for i in range(LANES)]
    keyed = met.select("conv_id", "block", F.col("place").alias("depth"), "n_bytes", (F.col("place") == F.col("length")).alias("ends"),
                       _key(F.col("place"), whole).alias("key"), _key(F.col("place") - 1, [x - F.col(f"l{i}") for i, x in enumerate(whole)]).alias("parent"))
    band = F.collect_list("key").over(Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(1 - height, 0))
    # depth d has d % height nodes above it in its band; the root, which has no row, is one in the first
    listed = keyed.withColumn("all", band).withColumn("up", (F.col("depth") % height).cast("int"))
    above = F.when(F.col("depth") < height, F.concat(F.array(F.lit(ROOT)), F.col("all"))).otherwise(F.slice("all", -(F.col("up") + 1), F.col("up") + 1))
    return listed.select("key", "conv_id", "depth", "parent", "n_bytes", above.alias("above"), "ends")


def band_totals(nodes: DataFrame, height: int, depth: int, values: list[str], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, values): sums over every node's subtree of (key, depth, parent, above, over, values).

    `over` are a parent's `above` where the node is a band's root, else null.
    """
    add = [F.sum(v).alias(v) for v in values]
    inside = cut(nodes.select(F.explode("above").alias("key"), *values).groupBy("key").agg(*add))
    if depth < height:
        return inside
    roots = cut(nodes.filter((F.col("depth") % height == 0) & (F.col("depth") > 0)).select("key", "depth", "over").join(inside, "key"))
    done: list[DataFrame] = []
    carried: DataFrame | None = None
    for at in range(depth // height * height, 0, -height):
        level = roots.filter(F.col("depth") == at)
        if carried is not None:
            level = level.select("key", "depth", "over", *values).union(carried).groupBy("key").agg(F.max("depth").alias("depth"), F.max("over").alias("over"), *add)
        level = cut(level)
        done.append(level)
        carried = level.select(F.col("over")[0].alias("key"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("array<binary>").alias("over"), *values) if at > height else None
    spread = [d.select(F.explode("over").alias("key"), *values) for d in done]
    # a band root's `over` ends at its parent; what lies above the parent's own band root comes through that one's total
    up = inside
    for s in spread:
        up = up.union(s)
    return up.groupBy("key").agg(*add)


def ends_of(prefix: DataFrame, turnless: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which conversations end."""
    rows = prefix.filter("ends").select("key", "conv_id").union(turnless.select(F.lit(ROOT), "conv_id"))
    pieces = rows.groupBy("key", F.floor(F.col("conv_id") / RANGE).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    counted = rows.select("key", F.floor(F.col("conv_id") / RANGE).alias("part")).distinct().groupBy("key").agg(F.count("*").alias("parts")).filter("parts > 1").select("key")
    several = pieces.join(counted, "key", "left_semi")
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, hashlib.sha256()
        for b in batches:
            for i in range(b.num_rows):
                k, ids = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], schema=schema)
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], schema=schema)

    streamed = several.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")
    return pieces.join(counted, "key", "left_anti").select("key", F.sha2("ids", 256).alias("ends_sha256")).union(streamed)


def height_for(depth: int) -> int:
    h = 16
    while h * h < depth and h < BLOCK:
        h *= 2
    return h


def trie(rows: DataFrame, lengths: DataFrame, height: int | None = None) -> DataFrame:
    """Nodes of (conv_id, place, digest, n_bytes, length) and (conv_id, length) with their subtree totals."""
    t = Tables(rows.sparkSession)
    cut = t.cut
    lengths = cut(lengths)
    depth = lengths.agg(F.max("length")).first()[0]
    height = height or height_for(depth or 0)
    if BLOCK % height:
        raise ValueError(f"height must divide {BLOCK}")
    pre = cut(prefixes(rows, height))
    least = pre.groupBy("key").agg(F.min(F.struct("conv_id", "depth", "parent", "n_bytes", "above")).alias("m"), F.count("*").alias("n_convs")).select("key", "m.*", "n_convs")
    whole = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = whole.select(F.lit(ROOT).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_bytes"), F.array(F.lit(ROOT)).alias("above"), "n_convs")
    nodes = cut(least.union(root))
    total = nodes.count()
    children = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    placed = cut(nodes.join(children.select(F.col("parent").alias("_p"), "n_children"), F.col("key") == F.col("_p"), "left").drop("_p").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # what a child needs of its parent: its least member and, for a band's root, the parent's ancestors in their band
    facts = placed.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.when((F.col("depth") + 1) % height == 0, F.col("above")).alias("over"), F.col("n_children").alias("_n"))
    own = placed.select("key", "conv_id", "depth", "parent", "n_bytes", "above", "n_convs", "n_children")
    met = cut(join_facts(own, "parent", [F.col("key")], facts, "_n", total).drop("_n").withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")))
    sums = band_totals(met.select("key", "depth", "above", "over", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens")), height, depth or 0, ["n_leaves", "saved_tokens"], cut)
    ends = ends_of(pre, lengths.filter("length = 0"))
    out = met.drop("above", "over").join(sums, "key").join(ends, "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")).checkpoint()
    t.drop()
    return out


def rebuilt_trie(conversations: DataFrame, height: int | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations that start with others' turns."""
    rows, lengths = branched(ranked(turns_of(conversations, conv, turn, role, text)))
    return trie(rows, lengths, height)


def plain_trie(conversations: DataFrame, height: int | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations as they are."""
    rows = ranked(turns_of(conversations, conv, turn, role, text))
    lengths = rows.groupBy("conv_id").agg(F.count("*").alias("length"))
    return trie(rows.join(lengths, "conv_id"), lengths, height)


def query(spark, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_DIGEST = "md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))"
ORACLE = f"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS tb FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_DIGEST}) AS place, {_DIGEST} AS g, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
hs AS (SELECT conv_id, n, conv_id - conv_id % {GROUP} AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(conv_id::VARCHAR), '..'), lambda q: ('0x' || q)::BIGINT)),
      lambda x, y: xor(x // 256, tb[xor(x % 256, y) + 1])), 4294967295) % {HEADS + 1} AS h FROM c, tab),
f AS (SELECT hs.conv_id, hs.base, CASE WHEN hs.conv_id = hs.base THEN 0 ELSE h END AS h, CASE WHEN hs.conv_id = hs.base THEN 0 ELSE least(h, coalesce(c.n, 0)) END AS taken FROM hs LEFT JOIN c ON c.conv_id = hs.base),
r AS (SELECT o.conv_id, o.place - f.h + f.taken AS d, g, b FROM o JOIN f ON f.conv_id = o.conv_id WHERE o.place > f.h
  UNION ALL SELECT f.conv_id, o.place, g, b FROM f JOIN o ON o.conv_id = f.base WHERE o.place <= f.taken),
p AS (SELECT conv_id, d, b, md5(string_agg(g, ',') OVER (PARTITION BY conv_id ORDER BY d)) || ':' || d AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM f),
n AS (SELECT k, min(conv_id) AS conv_id, any_value(d) AS d, any_value(b) AS b, count(*) AS n FROM p GROUP BY k),
l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
e AS (SELECT p.k, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids FROM p JOIN l ON l.conv_id = p.conv_id AND l.d = p.d GROUP BY p.k),
up AS (SELECT n.k, a.k AS anc, a.d AS ad FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d),
par AS (SELECT up.k, up.anc AS pk, q.conv_id AS pc FROM up JOIN n m ON m.k = up.k JOIN n q ON q.k = up.anc WHERE up.ad = m.d - 1),
ch AS (SELECT pk AS k, count(*) AS m FROM par GROUP BY pk),
s AS (SELECT up.anc AS k, count(*) FILTER (coalesce(ch.m, 0) = 0) AS leaves, sum((n.n - 1) * n.b) AS saved FROM up JOIN n ON n.k = up.k LEFT JOIN ch ON ch.k = up.k GROUP BY up.anc)
SELECT n.conv_id, n.d::BIGINT AS depth, par.pc AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(ch.m, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n LEFT JOIN par USING (k) LEFT JOIN ch USING (k) JOIN s USING (k) LEFT JOIN e USING (k)
"""
