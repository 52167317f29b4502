"""MinHash near-dedup by a chosen-path set similarity join.

Documents with equal shingle sets are one class first. Every class has a vector
of minwise tokens. Each of TREES independent trees branches the classes by one
minwise token; a node that is still large branches again by a minwise token that
its own key selects. A small node is compared exhaustively on sketches, which gives candidate links. A
large node whose members resemble each other (most of them choose the same tokens)
isn't branched further: all its members are candidates of each other.

Classes that candidate links join, directly or not, form a group, and every class
belongs to one group, so its full set is made and shipped once. In a group of up to
SMALL members everything is compared with everything on full sets, but for rows that
are joined already. Larger groups go in chunks: first every chunk alone, then with
the members that had the most links anywhere in the group, which joins copies to the
text they were made from; what is still apart then is compared completely, within
every small node and, for alike nodes, with all members in blocks. Pairs are formed
in the tasks' memory only and never written; none is left out.

Recall: two documents of similarity 0.8 share a token with probability 0.8, so 16
trees miss a pair of small nodes with 0.2^16 = 7e-12. Where a passage that very
many documents share makes half of both, a tree keeps the pair in a small node
through other tokens with 0.3, or with 0.5 * 0.8^d behind d levels: after two levels
all trees miss it with 2e-7, after five with 5e-5. Documents of which such a passage
makes more resemble each other, and their nodes are alike. The sketches' bar lies
five standard deviations below 0.8.

Defined results: documents without words, or with a null text, have an empty set
and are linked with nothing; rows with a null id are linked with nothing, have
component_id null and are kept; repeated rows are copies like others; rows that
share an id but not the text are documents of their own; an empty table gives an
empty table; other columns are ignored (components) or kept (drop_near_copies).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardwalk.llm.arrow import ascii_lower, map_rows
from guardwalk.llm.hot import join_facts
from guardwalk.session import checkpoint_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WIDTH, PERCENT = 4, 80
TREES, SKETCH, DEPTH = 16, 128, 6
#: Members of a node or group that is compared at once, and tokens of their sets together.
SMALL, TOKENS = 512, 1 << 22
#: Members of a chunk of a larger group; members of a chunk, and of a group, that meet all its chunks.
CHUNK, HUBS, PIVOTS = 256, 2, 32
#: From this mean similarity on a node is alike; from the lower one on if it has at most so many members.
ALIKE, ALIKE_LOW, LOW_SIZE = 0.5, 0.35, 2048
#: Members by which a node's mean similarity is estimated; the estimate only chooses between two complete ways.
PROBE = 64
_RNG = np.random.Generator(np.random.PCG64(20240229))
KEYS = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
PLACES = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


# ---- sets and sketches


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Digests(dict):
    """word -> 64-bit digest."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:  # bounds memory, not results
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Shingler:
    """Distinct shingles of whole texts as sorted 64-bit digests."""

    def __init__(self, width: int):
        self.width, self.words = width, Digests()

    def __call__(self, text: str | None) -> np.ndarray:
        found = WORD.findall(ascii_lower(text)) if text else []
        if not found:
            return np.zeros(0, np.uint64)
        a = np.fromiter(map(self.words.__getitem__, found), np.uint64, len(found))
        k = min(self.width, len(a))
        n = len(a) - k + 1
        with np.errstate(over="ignore"):
            s = np.full(n, k, np.uint64)
            for i in range(k):
                s += _mixed(a[i : i + n] + PLACES[i % 64]) * PLACES[(i + 7) % 64]
            return np.unique(_mixed(s))


_ROWS = 64
_PRODUCTS = np.empty((_ROWS, SKETCH), np.uint64)


def minwise(tokens: np.ndarray) -> np.ndarray:
    """For every key the least keyed token (64 bits). The products of few tokens at a time stay in the cache."""
    best = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    column = tokens[:, None]
    for i in range(0, len(tokens), _ROWS):
        part = column[i : i + _ROWS]
        out = np.multiply(part, KEYS, out=_PRODUCTS[: len(part)])
        np.minimum(best, out.min(0), out=best)
    return best


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, digest, n, set_key, roots, sketch): 64 bits per tree's first token, 16 per sketch coordinate.

    `digest` is the text's; id and digest find a row again.
    """

    def make():
        shingle = Shingler(width)

        def one(doc_id, digest, text):
            s = shingle(text)
            if not len(s):
                return doc_id, digest, 0, None, None, None
            m = minwise(s)
            with np.errstate(over="ignore"):
                v = _mixed(m)
            return doc_id, digest, len(s), key_of(s), v[:TREES].tobytes(), (v >> np.uint64(48)).astype(np.uint16).tobytes()

        return one

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs, [docs[id_col], text_digest(docs[text_col]), docs[text_col]], f"doc_id {kind}, digest binary, n long, set_key binary, roots binary, sketch binary", make)


def key_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


# ---- comparison inside groups


def in_groups(rows: DataFrame, schema: str, work: Callable[[list[tuple]], list[tuple]], parts: int | None = None) -> DataFrame:
    """`work` on the rows of each `key` (the first column), one group in memory at a time; later rows with a set_key (the second) already held are dropped."""
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in rows.sparkSession.createDataFrame([], schema).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        key, made = None, []

        def packed() -> pa.RecordBatch:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, schema=out)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    if r[0] != key:
                        if len(held) > 1:
                            made += work(list(held.values()))
                        held, key = {}, r[0]
                    held.setdefault(r[1], r)
                if len(made) > 5000:
                    yield packed()
        if len(held) > 1:
            made += work(list(held.values()))
        if made:
            yield packed()

    return rows.repartition(*([parts] if parts else []), "key").sortWithinPartitions("key").mapInArrow(run, schema)


def spread(labels: list, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Stars (first, other) that join what links join, for rows with different labels.

    A row that is reached is compared with the rows that aren't yet, and with no others,
    so a group with links all around takes few comparisons. Rows of one label are reached
    together.
    """
    numbers: dict = {}
    at = np.array([numbers.setdefault(x, len(numbers)) for x in labels])
    waiting, out = np.ones(len(at), bool), []
    for first in range(len(at)):
        if not waiting[first]:
            continue
        reached = at == at[first]
        waiting[reached] = False
        queue = list(np.flatnonzero(reached))
        while queue and waiting.any():
            i = queue.pop()
            for j in near(int(i), np.flatnonzero(waiting)):
                if waiting[j]:
                    out.append((first, int(j)))
                    more = np.flatnonzero(at == at[j])
                    waiting[more] = False
                    queue.extend(more)
    return out


def like(rows: list[tuple], bar: float, percent: int) -> list[tuple]:
    """Candidate links (a, b) among (key, set_key, n, sketch) by their sketches, as far as they join candidates."""
    rows = sorted(rows, key=lambda r: r[1])
    m = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), SKETCH)
    n = np.array([r[2] for r in rows])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        some = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
        return some[(m[some] == m[i]).sum(1) >= bar]

    return [(rows[i][1], rows[j][1]) for i, j in spread(range(len(rows)), near)]


class Sets:
    """The full sets of a group's rows (key, set_key, label, tokens), held against each other."""

    def __init__(self, rows: list[tuple], percent: int):
        self.percent = percent
        own = [np.frombuffer(r[3], np.uint64) for r in rows]
        self.n = np.array([len(x) for x in own])
        flat, times = np.unique(np.concatenate(own), return_counts=True)
        shared = flat[times > 1]  # a token of one row alone is in no intersection
        self.ids, self.mark = [], np.zeros(len(shared) + 1, bool)
        for x in own:
            i = np.searchsorted(shared, x)
            i[i == len(shared)] = 0
            self.ids.append(i[shared[i] == x] if len(shared) else i[:0])
        self.held = np.array([len(x) for x in self.ids])

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that are linked with row i: the exact test on full sets."""
        both = self.n[others] + self.n[i]
        most = np.minimum(self.held[others], self.held[i])
        some = others[(most > 0) & (100 * most >= self.percent * (both - most))]
        if not len(some):
            return some
        self.mark[self.ids[i]] = True
        hits = self.mark[np.concatenate([self.ids[j] for j in some])]
        self.mark[self.ids[i]] = False
        starts = np.concatenate([[0], np.cumsum(self.held[some])[:-1]])
        same = np.add.reduceat(hits, starts, dtype=np.int64)
        return some[(same > 0) & (100 * same >= self.percent * (self.n[some] + self.n[i] - same))]


def joined(rows: list[tuple], percent: int) -> list[tuple]:
    """(a, b) for rows (key, set_key, label, tokens): what confirmed links join beyond the labels."""
    rows = sorted(rows, key=lambda r: r[1])
    s = Sets(rows, percent)
    return [(rows[i][1], rows[j][1]) for i, j in spread([r[2] for r in rows], s.near)]


def with_hubs(rows: list[tuple], percent: int) -> list[tuple]:
    """As `joined` (links 0), and (a, a, links) for the HUBS rows with the most links."""
    rows = sorted(rows, key=lambda r: r[1])
    s, every = Sets(rows, percent), np.arange(len(rows))
    links = [s.near(i, every) for i in range(len(rows))]
    top = sorted(range(len(rows)), key=lambda i: -len(links[i]))[:HUBS]
    stars = [(rows[i][1], rows[j][1], 0) for i, j in spread([r[2] for r in rows], lambda i, _: links[i])]
    return stars + [(rows[i][1], rows[i][1], len(links[i])) for i in top if len(links[i]) > 1]


# ---- components


class Tables:
    """Intermediate results as Parquet under one folder of the shared one: a plan that reads them holds nothing of those that made them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{checkpoint_dir(spark)}/neardup-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component): the least node reachable, by alternating large and small stars until only stars are left."""
    cut = cut or Tables(edges.sparkSession).cut
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())  # u > v
    while True:
        sides = e.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above"), F.lit(1).alias("edges")).union(e.select("v", F.lit(0), F.lit(1), F.lit(0)))
        ends = sides.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"), F.sum("edges").alias("edges"))
        n, undone = ends.agg(F.coalesce(F.sum("edges"), F.lit(0)), F.count_if((F.col("below") > 1) | (F.col("below") > 0) & (F.col("above") > 0))).first()
        if not undone:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"), "d")
        large = join_facts(both.withColumn("k", F.col("u")), "k", [F.col("u"), F.col("v")], m, "d", 2 * n)
        l = large.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeated ones go below
        below = l.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).withColumnRenamed("u", "k")
        small = join_facts(l.withColumn("k", F.col("u")), "k", [F.col("u"), F.col("v")], below, "d", n)
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        e = cut(small.select(F.explode(pairs).alias("p")).select("p.u", "p.v").filter("u <> v").distinct())


# ---- the join


def grow(reps: DataFrame, total: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, set_key, cnt, dense): every tree's leaves with two members or more, small ones and large alike (dense) ones."""
    roots = F.array(*[F.xxhash64(F.lit(t), F.substring("roots", 8 * t + 1, 8)) for t in range(TREES)])
    first = reps.select("set_key", F.explode(roots).alias("key"))

    def with_count(rows: DataFrame, size: int) -> DataFrame:
        c = rows.groupBy("key").agg(F.count("*").alias("cnt")).filter("cnt > 1")
        return join_facts(rows, "key", [F.col("set_key")], c, "cnt", size).filter("cnt > 1")

    leaf = ["key", "set_key", "cnt"]
    nodes = cut(with_count(first, TREES * total))
    done, big = [nodes.filter(F.col("cnt") <= SMALL).select(*leaf, F.lit(False).alias("dense"))], nodes.filter(F.col("cnt") > SMALL)
    for level in range(1, DEPTH + 1):
        size = big.count()
        if not size:
            break
        if level == DEPTH:
            done.append(big.select(*leaf, F.lit(True)))
            break
        if level == 1:
            big = cut(big.join(reps.select("set_key", "sketch").hint("shuffle_hash"), "set_key"))
        token = lambda j: F.substring(F.col("sketch"), 2 * F.pmod(F.xxhash64("key", F.lit(j)), F.lit(SKETCH)).cast("int") + 1, F.lit(2))
        child = F.xxhash64("key", F.lit(level), token(0))
        # pairs of the probe that choose the same token estimate the members' mean similarity
        probe = big.filter(F.pmod(F.xxhash64("set_key", "key", F.lit(level)), F.col("cnt")) < PROBE).repartition("key")  # for all groupings below
        picks = probe.select("key", "cnt", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), token(j + 1).alias("v")) for j in range(4)])).alias("p"))
        same = picks.groupBy("key", "cnt", "p").agg(F.count("*").alias("n")).groupBy("key", "cnt", "p.j").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), F.sum("n").alias("m"))
        mean = F.sum("same") / F.greatest(F.sum(F.col("m") * (F.col("m") - 1)), F.lit(1))
        route = same.groupBy("key", "cnt").agg(mean.alias("mean")).select("key", F.col("cnt").alias("n_node"), ((F.col("mean") >= ALIKE) | (F.col("mean") >= ALIKE_LOW) & (F.col("cnt") <= LOW_SIZE)).alias("dense"))
        routed = join_facts(big, "key", [F.col("set_key")], route, "n_node", size).withColumn("dense", F.coalesce("dense", F.lit(False)))
        kids = cut(with_count(routed.select("set_key", "sketch", "dense", F.when(F.col("dense"), F.col("key")).otherwise(child).alias("key")), size))
        done.append(kids.filter((F.col("cnt") <= SMALL) | F.col("dense")).select(*leaf, "dense"))
        big = kids.filter((F.col("cnt") > SMALL) & ~F.col("dense")).select(*leaf, "sketch")
    return cut(reduce(DataFrame.union, done))


def rooted(stars: DataFrame) -> DataFrame:
    """Stars (node, component) with a row of its own for every component's root."""
    return stars.union(stars.select("component", "component").distinct())


def candidate_edges(reps: DataFrame, small: DataFrame, alike: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of a small node are candidates of each other by their sketches, members of a large alike node all of them."""
    bar = SKETCH * (percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / SKETCH) ** 0.5)
    told = small.select("key", "set_key").join(reps.select("set_key", "n", "sketch").hint("shuffle_hash"), "set_key").select("key", "set_key", "n", "sketch")
    return in_groups(told, "a binary, b binary", lambda rows: like(rows, bar, percent)).union(star_edges(alike))


def star_edges(alike: DataFrame) -> DataFrame:
    """(a, b): every member of a node (key, set_key) with the node's least one."""
    least = alike.groupBy("key").agg(F.min("set_key").alias("b"), F.count("*").alias("n_node"))
    return join_facts(alike, "key", [F.col("set_key")], least, "n_node", alike.count()).select(F.col("set_key").alias("a"), "b")


def candidates(reps: DataFrame, edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(set_key, rep, digest, cc, members, chunks): classes that candidate links join, and how many chunks their group takes.

    Only classes of one group need comparing.
    """
    groups = rooted(components(edges, cut))
    named = cut(groups.withColumnRenamed("component", "cc").join(reps.select("set_key", "rep", "digest", "n").hint("shuffle_hash"), F.col("node") == F.col("set_key")).drop("node"))
    sizes = named.groupBy("cc").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    chunks = F.when((F.col("members") <= SMALL) & (F.col("tokens") <= TOKENS), 1).otherwise(F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(2 * F.col("tokens") / TOKENS), F.lit(2)))
    facts = sizes.select("cc", "members", chunks.cast("long").alias("chunks"))
    return join_facts(named.select("set_key", "rep", "digest", "cc"), "cc", [F.col("set_key")], facts, "members", named.count())


def chunk_of(salt: int) -> Column:
    return F.pmod(F.xxhash64("set_key", F.lit(salt)), F.col("chunks"))


def large_links(large: DataFrame, small: DataFrame, alike: DataFrame, percent: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): what confirmed links join within the groups of several chunks (set_key, cc, members, chunks, tokens).

    First every chunk alone, which also gives the members with the most links; then the
    chunks with those of the whole group, which joins near copies to the text they were
    made from. What that leaves apart is compared completely: within every small node,
    and between all members of alike nodes in blocks, pairs of one component left out.
    """
    inside = large.select(F.xxhash64("cc", chunk_of(1)).alias("key"), "set_key", F.col("set_key").alias("label"), "tokens")
    first = cut(in_groups(inside, "a binary, b binary, links long", lambda rows: with_hubs(rows, percent)))
    hubs = first.filter("links > 0").select(F.col("a").alias("hub"), "links")
    bare = large.select("set_key", "cc", "members", "chunks")
    ranked = hubs.join(bare.dropDuplicates(["set_key"]), F.col("hub") == F.col("set_key")).select("set_key", "cc", "chunks", "links")
    top = ranked.withColumn("at", F.row_number().over(Window.partitionBy("cc").orderBy(F.desc("links"), "set_key"))).filter(F.col("at") <= PIVOTS)
    labels = first.filter("links = 0").select(F.col("b").alias("node"), "a")  # chunks don't overlap, nor do their stars
    told = cut(large.join(labels.hint("shuffle_hash"), F.col("set_key") == F.col("node"), "left").select("set_key", "cc", "members", "chunks", "tokens", F.coalesce("a", "set_key").alias("label")))
    pivots = top.select("set_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c")).join(told.select("set_key", "cc", "label", "tokens"), "set_key")
    again = told.select(F.xxhash64("cc", chunk_of(1)).alias("key"), "set_key", "label", "tokens").union(pivots.select(F.xxhash64("cc", "c"), "set_key", "label", "tokens"))
    links = cut(first.filter("links = 0").select("a", "b").union(in_groups(again, "a binary, b binary", lambda rows: joined(rows, percent))))
    labels = rooted(components(links, cut))
    now = told.drop("label").join(labels.hint("shuffle_hash"), F.col("set_key") == F.col("node"), "left").withColumn("label", F.coalesce("component", "set_key")).drop("node", "component")
    per = now.select("set_key", "cc", "label").distinct().groupBy("cc", "label").agg(F.count("*").alias("n"))
    main = per.groupBy("cc").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("n_cc")).filter("labels > 1")
    open_ = cut(join_facts(now.drop("chunks"), "cc", [F.col("set_key")], main, "n_cc", told.count()).filter("labels > 1"))
    if open_.isEmpty():
        return links
    # members of one small node that are still apart
    bare = open_.select("set_key", "cc", "label").distinct()
    sized = small.select(F.col("key").alias("node"), "set_key").join(bare.hint("shuffle_hash"), "set_key").withColumn("key", F.xxhash64("node", "cc")).drop("node")
    split = sized.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    left = sized.join(split.hint("shuffle_hash"), "key").select("key", "set_key").join(open_.select("set_key", "label", "tokens"), "set_key").select("key", "set_key", "label", "tokens")
    # members of alike nodes: those outside the main component against all
    near = open_.join(alike.select("set_key").distinct().hint("shuffle_hash"), "set_key", "left_semi").withColumn("rest", F.col("label") != F.col("main"))
    counts = near.select("set_key", "cc", "rest").distinct().groupBy("cc").agg(F.count_if("rest").alias("n_rest"), F.count("*").alias("n_all")).filter("n_rest > 0")
    dealt = join_facts(near, "cc", [F.col("set_key")], counts, "n_all", open_.count()).filter("n_rest > 0")
    rows, cols = F.ceil(F.col("n_rest") / SMALL), F.ceil(F.col("n_all") / SMALL)  # every set is sent once for each block across, so blocks are large
    at = lambda n: F.pmod(F.xxhash64("set_key", F.lit(2)), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    block = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
    across = F.when(F.col("rest"), F.transform(upto(cols), lambda j: block(at(rows), j)))
    down = F.transform(upto(rows), lambda i: block(i, at(cols)))
    each = dealt.select("cc", "set_key", "label", "tokens", F.explode(F.array_distinct(F.concat(F.coalesce(across, F.array().cast("array<struct<i:bigint,j:bigint>>")), down))).alias("b"))  # one pass: sets are shuffled to their facts once
    blocks = each.select(F.xxhash64("cc", "b.i", "b.j").alias("key"), "set_key", "label", "tokens")
    return links.union(in_groups(left.union(blocks), "a binary, b binary", lambda rows: joined(rows, percent)))


def classified(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(doc_id, digest, n, root, component_id): every row's class of near copies; no root without words or id."""
    t = Tables(docs.sparkSession)
    cut = t.cut
    sets = cut(sketches(docs, id_col, text_col, width))
    classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "digest", "n", "roots", "sketch")).alias("m"), F.count("*").alias("copies"))
    reps = cut(classes.select("set_key", F.col("m.doc_id").alias("rep"), "m.digest", "m.n", "m.roots", "m.sketch", "copies"))
    leaves = grow(reps, reps.count(), cut)
    small, alike = leaves.filter("NOT dense"), leaves.filter("dense")
    edges = candidate_edges(reps, small, alike, percent)
    return confirmed(docs, id_col, text_col, width, percent, sets, reps, edges, small, alike, t)


def confirmed(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, sets: DataFrame, reps: DataFrame, edges: DataFrame, small: DataFrame, alike: DataFrame, t: Tables, verify: Callable[[list[tuple], int], list[tuple]] = joined) -> DataFrame:
    """What `classified` gives, from candidate `edges` and the nodes (key, set_key) that hold every linked pair.

    Candidates are verified on full sets, whose classes come from `sets` (doc_id, digest, n, set_key) and
    `reps` (set_key, rep, digest, n, copies).
    """
    cut = t.cut
    found = candidates(reps, edges, cut)
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    held = texts.join(found.withColumnRenamed("digest", "_d").hint("shuffle_hash"), (F.col("_id") == F.col("rep")) & (text_digest(F.col("_text")) == F.col("_d")))

    def make():
        shingle = Shingler(width)
        return lambda set_key, cc, members, chunks, text: (set_key, cc, members, chunks, shingle(text).tobytes())

    wanted = [held[c] for c in ("set_key", "cc", "members", "chunks", "_text")]
    full = cut(map_rows(held, wanted, "set_key binary, cc binary, members long, chunks long, tokens binary", make))
    alone = full.filter("chunks = 1").select(F.col("cc").alias("key"), "set_key", F.col("set_key").alias("label"), "tokens")
    links = in_groups(alone, "a binary, b binary", lambda rows: verify(rows, percent))
    large = full.filter("chunks > 1")
    if not large.isEmpty():
        links = links.union(large_links(large, small, alike, percent, cut))
    stars = rooted(components(links, cut)).withColumnRenamed("component", "root")
    mine = cut(reps.select("set_key", "rep", "copies").join(stars.hint("shuffle_hash"), F.col("set_key") == F.col("node"), "left").drop("node").filter("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "set_key")))
    least = mine.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("n_classes"))
    facts = join_facts(mine, "root", [F.col("set_key")], least, "n_classes", mine.count()).select("set_key", "root", "component", "copies")
    linked = F.col("doc_id").isNotNull() & F.col("set_key").isNotNull()
    alone_key = F.encode(F.concat_ws(":", F.lit("none"), F.col("doc_id").cast("string"), F.spark_partition_id().cast("string")), "utf-8")  # spread over tasks
    rows = sets.select("doc_id", "digest", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("own"), F.when(linked, F.col("set_key")).otherwise(alone_key).alias("set_key"))
    j = join_facts(rows, "set_key", [F.col("doc_id")], facts, "copies", rows.count())
    lone = F.col("own").isNull()
    out = j.select("doc_id", "digest", "n", F.when(~lone, F.coalesce("root", "own")).alias("root"), F.when(lone, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id")).checkpoint()
    t.drop()
    return out


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return classified(docs, id_col, text_col, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each group (the least id; of its rows the one with the least text digest, then the least one) with all its columns.

    Rows without words or without id stay, all of them.
    """
    told = classified(docs, id_col, text_col, width, percent).filter("doc_id IS NOT NULL")
    first = told.filter("root IS NOT NULL AND doc_id = component_id").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("rows"))
    one = first.groupBy("root").agg(F.min(F.struct("doc_id", "digest", "rows")).alias("m")).select("m.*")
    lone = told.filter("root IS NULL").select("doc_id", "digest", F.lit(1).cast("long").alias("rows")).distinct()
    keep = one.union(lone).checkpoint().select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept"), F.col("rows").alias("_rows"))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_key"), text_digest(docs[text_col]).alias("_digest"))
    met = row.join(keep.hint("shuffle_hash"), (F.col("_key") == F.col("_id")) & (F.col("_digest") == F.col("_kept")), "left")
    out = met.filter("_rows = 1 OR _key IS NULL").select("_row")
    if not keep.filter("_rows > 1").isEmpty():
        by = F.struct(*[F.col("_row")[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
        out = out.union(met.filter("_rows > 1").groupBy("_key", "_digest").agg(F.min_by("_row", by).alias("_row")).select("_row"))
    return out.select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(percent: int = PERCENT, more: str = ", d.doc_id = m.c AS kept") -> str:
    """All pairs that share a shingle, in DuckDB."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id{more}
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""


ORACLE = oracle()
