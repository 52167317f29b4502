"""N-gram Jaccard join by rare-first prefix filtering.

Documents with equal shingle sets are one class. All shingles stand in one total order,
rarest first, and two sets with a Jaccard similarity of t share a shingle among their
first n - ceil(t n) + 1 ones, so only these are joined. Frequencies come from COUNTERS
counters that shingles are hashed to: an upper bound of each frequency, of fixed size
whatever the corpus, added up over all documents; ties go by the shingle's digest. Any
total order gives the same result, so a bound that is too high costs time only. (An exact
table would shuffle every shingle of the corpus three times: to count it, to send its count
back, and to bring documents together again.)

A posting is (shingle, class, size, place in the order). Shingles that one class alone has go.
Of shingles that the very same classes share only the rarest stays, so a pair meets once for all
of them: where both first meet is always kept. Within a shingle's group two classes are candidates if
the positional filter lets them be, which holds the length filter too: what is left of
either set from the shingle on must be able to reach the overlap that t asks for. Groups
beyond SMALL members are dealt by length bands first; a band that is still large goes in chunks
with shared pivots, and what these leave apart is compared with all of the band. Candidates' full sets then come together once, and are verified there, behind
a suffix filter (fixed pivots cut sets into ranges; the ranges' differences in size bound
the symmetric difference from below), each pair once at most; pairs that links have joined already
aren't verified. Pairs are held in the tasks' memory only. No pair of linked texts is lost: prefix,
positional, length and suffix filters are all exact.

Defined results: as in `neardup` - documents without words, or with a null text, have an
empty set and are linked with nothing; rows with a null id are linked with nothing and have
component_id null; repeated rows are copies; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardwalk.llm import neardup
from guardwalk.llm.arrow import SLICE
from guardwalk.llm.neardup import SMALL, Sets, Shingler, Tables, confirmed, in_groups, key_of, spread, text_digest

WIDTH, PERCENT = 4, 85
#: Counters of shingle frequencies, and the pieces they travel in.
COUNTERS, PIECE = 1 << 19, 1 << 16
#: Shingles that a task gathers before it counts them, and postings before it gives them out.
HELD = 1 << 20
#: Sets of a task that are remembered, so that copies in one task give one set's postings; bounds memory, not results.
SEEN = 500_000
#: Ranges that the suffix filter's pivots make, at least and at most; there is one to 8 or 16 shingles.
RANGES, MOST_RANGES = 32, 1024


def ranges_of(tokens: np.ndarray) -> np.ndarray:
    """How many shingles lie in each of equal ranges, as far as a byte tells: differences of these bound the symmetric difference from below."""
    r = min(MOST_RANGES, max(RANGES, 1 << (len(tokens) // 16).bit_length()))
    return np.minimum(np.bincount((tokens >> np.uint64(65 - r.bit_length())).astype(np.int64), minlength=r), 255).astype(np.uint8)


def described(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (doc_id, digest, n, set_key, ranges) of documents, and rows (piece, counts) of the task's counters with the other columns null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, digest binary, n long, set_key binary, ranges binary, piece int, counts binary"
    out = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts, held, size = Shingler(width), np.zeros(COUNTERS, np.int64), [], 0

        def count() -> None:
            nonlocal size
            if held:
                counts[:] += np.bincount((np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                held.clear()
                size = 0

        for b in batches:
            n, keys, ranges = [], [], []
            for at in range(0, b.num_rows, SLICE):
                for text in b.column(2).slice(at, SLICE).to_pylist():
                    s = shingle(text)
                    n.append(len(s))
                    keys.append(key_of(s) if len(s) else None)
                    ranges.append(ranges_of(s).tobytes() if len(s) else None)
                    if len(s):
                        held.append(s)
                        size += len(s)
                        if size >= HELD:
                            count()
            none = [pa.nulls(len(n), f.type) for f in list(out)[5:]]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(out.field(0).type), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(ranges, pa.binary()), *none], schema=out)
        count()
        pieces = [zlib.compress(counts[at : at + PIECE].tobytes(), 1) for at in range(0, COUNTERS, PIECE)]
        if counts.any():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(pieces), f.type) for f in list(out)[:5]], pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], schema=out)

    return docs.select(docs[id_col], text_digest(docs[text_col]), docs[text_col]).mapInArrow(run, schema)


def frequencies(described_: DataFrame) -> np.ndarray:
    """The tasks' counters added up, in 32 bits: COUNTERS of them, 2 MB."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                k, x = b.column(0)[i].as_py(), np.frombuffer(zlib.decompress(b.column(1)[i].as_py()), np.int64)
                held[k] = held[k] + x if k in held else x
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["piece", "counts"])

    kind = "piece int, counts binary"
    parts = described_.filter("piece IS NOT NULL").select("piece", "counts").mapInArrow(add, kind).repartition("piece").mapInArrow(add, kind).collect()
    total = np.zeros(COUNTERS, np.int64)
    for r in parts:
        total[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.minimum(total, (1 << 32) - 1).astype(np.uint32)


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


def postings(docs: DataFrame, text_col: str, width: int, percent: int, often: np.ndarray) -> DataFrame:
    """(token, hi, lo, place) of every set's prefix; hi and lo are the set's key, place its size * 2^32 + the token's place. A set may come once from every task."""
    shared = docs.sparkSession.sparkContext.broadcast(often)  # COUNTERS numbers, whatever the corpus
    schema = pa.schema([("token", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts, seen = Shingler(width), shared.value, set()
        tokens, keys, sizes, size = [], [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal size
            k = np.array([len(t) for t in tokens])
            pair = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            columns = [np.concatenate(tokens).view(np.int64), np.repeat(pair[:, 0], k), np.repeat(pair[:, 1], k), (np.repeat(np.array(sizes, np.int64), k) << 32) + at]
            tokens.clear(), keys.clear(), sizes.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                for text in b.column(0).slice(at, SLICE).to_pylist():
                    s = shingle(text)
                    if not len(s) or (key := key_of(s)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    first = np.argsort(counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")[: prefix_size(len(s), percent)]
                    tokens.append(s[first])
                    keys.append(key)
                    sizes.append(len(s))
                    size += len(first)
                if size >= HELD // 8:
                    yield packed()
        if tokens:
            yield packed()

    return docs.select(docs[text_col]).mapInArrow(run, "token long, hi long, lo long, place long")


def shared_postings(rows: DataFrame) -> DataFrame:
    """(token, members, set_key, n, at): postings of shingles that several classes have; of shingles with the same classes, the rarest's."""
    rows = rows.filter("token IS NOT NULL").repartition("token")  # both uses below need the same rows and columns, so Spark makes and shuffles them once
    low = F.lit((1 << 31) - 1)
    pieces = [x for c in ("hi", "lo") for x in (F.col(c).bitwiseAND(low), F.shiftrightunsigned(F.col(c), 33))]
    told = rows.groupBy("token").agg(F.min("hi").alias("least"), F.max("hi").alias("most"), F.count("*").alias("members"), F.min_by("place", "hi").alias("place"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(pieces)])
    told = told.filter("least <> most")
    # equal sums of the members' keys: the same members; among their shingles places run alike in all of them
    kept = told.groupBy("members", "least", "most", *[f"s{i}" for i in range(4)]).agg(F.min_by("token", "place").alias("token")).select("token", "members")
    half = lambda c: F.lpad(F.hex(c), 16, "0")
    swap = lambda c: F.concat(*[F.substring(half(c), 15 - 2 * i, 2) for i in range(8)])  # noqa: E731  the key's bytes were read as little-endian numbers
    return rows.join(kept.hint("shuffle_hash"), "token").select("token", "members", F.unhex(F.concat(swap("hi"), swap("lo"))).alias("set_key"), F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))


class Ranged:
    """Ranges of a group's rows, held against each other; of two rows with different numbers of ranges the finer is folded."""

    def __init__(self, ranges: list[bytes], percent: int):
        self.percent = percent
        self.own = [np.frombuffer(x, np.uint8).astype(np.int32) for x in ranges]
        self.fine = np.array([len(x) for x in self.own])
        self.at = np.zeros(len(self.own), np.int64)
        self.tables = {}
        for r in np.unique(self.fine):
            mine = np.flatnonzero(self.fine == r)
            self.at[mine] = np.arange(len(mine))
            self.tables[int(r)] = np.stack([self.own[i] for i in mine])

    def near(self, i: int, others: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Those of `others` that may be linked with row i by their ranges; both: their sizes and row i's together."""
        apart = np.zeros(len(others), np.int64)
        for r, table in self.tables.items():
            some = np.flatnonzero(self.fine[others] == r)
            if len(some):
                low = min(r, len(self.own[i]))
                theirs = table[self.at[others[some]]].reshape(len(some), low, -1).sum(2)
                apart[some] = np.abs(theirs - self.own[i].reshape(low, -1).sum(1)).sum(1)
        return others[(100 + self.percent) * (both - apart) >= 2 * self.percent * both]


def may_link(rows: list[tuple], percent: int) -> list[tuple]:
    """Candidate links (a, b) among (key, set_key, n, at, ranges, and a label where some are joined already) that the length, positional and suffix filters leave, as far as they join candidates."""
    n, left = np.array([r[2] for r in rows], np.int64), np.array([r[2] - r[3] for r in rows], np.int64)
    if len(rows) == 2 and (100 + percent) * left.min() < percent * n.sum():
        return []
    ranged = Ranged([r[4] for r in rows], percent)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        some = others[(100 + percent) * np.minimum(left[others], left[i]) >= percent * (n[others] + n[i])]
        return ranged.near(i, some, n[some] + n[i]) if len(some) else some

    return [(rows[i][1], rows[j][1]) for i, j in spread([r[5] for r in rows] if len(rows[0]) > 5 else range(len(rows)), near)]


class Suffixed(Sets):
    """Full sets behind the suffix filter."""

    def __init__(self, rows: list[tuple], percent: int):
        super().__init__(rows, percent)
        self.ranged = Ranged([ranges_of(np.frombuffer(r[3], np.uint64)).tobytes() for r in rows], percent)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        return super().near(i, self.ranged.near(i, others, self.n[others] + self.n[i]))


def verified(rows: list[tuple], percent: int) -> list[tuple]:
    """(a, b) for rows (key, set_key, label, tokens): what confirmed links join."""
    rows = sorted(rows, key=lambda r: r[1])
    return [(rows[i][1], rows[j][1]) for i, j in spread([r[2] for r in rows], Suffixed(rows, percent).near)]


def joined_classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(doc_id, digest, n, root, component_id) per row."""
    t = Tables(docs.sparkSession)
    cut = t.cut
    told = cut(described(docs, id_col, text_col, width))
    sets = told.filter("piece IS NULL").drop("piece", "counts")
    classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "digest", "n", "ranges")).alias("m"), F.count("*").alias("copies"))
    reps = cut(classes.select("set_key", F.col("m.doc_id").alias("rep"), "m.digest", "m.n", "m.ranges", "copies"))
    named = docs.filter(docs[id_col].isNotNull())
    near = cut(shared_postings(postings(named, text_col, width, percent, frequencies(told))))
    bands = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / (percent - 0.1))))  # of two linked sets' bands one is at most one below the other
    dealt = near.filter(F.col("members") > SMALL).withColumn("band", F.explode(F.array(bands, bands - 1))).withColumn("key", F.xxhash64("token", "band")).drop("token", "band", "members")
    sized = cut(neardup.join_facts(dealt, "key", [F.col("set_key")], dealt.groupBy("key").agg(F.count("*").alias("members")), "members", dealt.count()))
    few = near.filter(F.col("members") <= SMALL).select(F.col("token").alias("key"), "set_key", "n", "at").union(sized.filter(F.col("members") <= SMALL).select("key", "set_key", "n", "at"))
    large = sized.filter(F.col("members") > SMALL)
    edges = candidate_links(few, large, reps, percent, cut)
    pairs = lambda df: df.select("key", "set_key")
    return confirmed(docs, id_col, text_col, width, percent, sets, reps, edges, pairs(few), pairs(large), t, verified)


def candidate_links(few: DataFrame, large: DataFrame, reps: DataFrame, percent: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): what candidate links join, within groups `few` (key, set_key, n, at) and `large` (the same and members), whose rows go in chunks first.

    A chunk also holds its group's pivots, so near copies of one text are joined across chunks. Of a large group only the rows outside its largest component
    are held against all rows then. Rows grow with the groups, but for those that stay apart though they share a shingle and a size.
    """
    known = reps.select("set_key", "ranges")
    parts = F.ceil(2 * F.col("members") / SMALL)
    chunk = F.pmod(F.xxhash64("set_key", "key"), parts)
    pivot = F.pmod(F.xxhash64("set_key", "key", F.lit(1)), F.col("members")) < SMALL // 16
    across = F.when(pivot, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(chunk))
    chunks = large.withColumn("c", F.explode(across)).select(F.xxhash64("key", "c").alias("key"), "set_key", "n", "at")

    def linked(rows: DataFrame, *label: str) -> DataFrame:
        told = rows.join(known.hint("shuffle_hash"), "set_key").select("key", "set_key", "n", "at", "ranges", *label)
        return in_groups(told, "a binary, b binary", lambda rows: may_link(rows, percent))

    first = cut(linked(few.union(chunks)))
    if large.isEmpty():
        return first
    stars = cut(neardup.rooted(neardup.components(first, cut)).withColumnRenamed("component", "label"))
    now = cut(large.drop("members").join(stars.hint("shuffle_hash"), F.col("set_key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "set_key")).drop("node"))
    per = now.groupBy("key", "label").agg(F.count("*").alias("n_label"))
    main = per.groupBy("key").agg(F.max_by("label", F.struct("n_label", "label")).alias("main"), F.max("n_label").alias("n_main"), F.sum("n_label").alias("n_key"))
    main = main.withColumn("n_rest", F.col("n_key") - F.col("n_main")).filter("n_rest > 0")
    apart = cut(neardup.join_facts(now, "key", [F.col("set_key")], main, "n_key", now.count()).filter("n_rest > 0").withColumn("rest", F.col("label") != F.col("main")))
    told = stars.select(F.col("node").alias("a"), F.col("label").alias("b"))  # what the chunks have joined, in place of their links
    if apart.isEmpty():
        return told
    rows, cols = F.ceil(F.col("n_rest") / SMALL), F.ceil(F.col("n_main") / SMALL)
    at = lambda n: F.pmod(F.xxhash64("set_key", F.lit(2)), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
    cells = F.when(F.col("rest"), F.transform(upto(cols), lambda j: cell(at(rows), j))).otherwise(F.transform(upto(rows), lambda i: cell(i, at(cols))))
    grid = apart.withColumn("c", F.explode(cells)).select(F.xxhash64("key", F.lit("grid"), "c.i", "c.j").alias("key"), "set_key", "n", "at")
    many = apart.filter(F.col("rest") & (F.col("n_rest") > SMALL)).select("key", "set_key", "n", "at", F.col("n_rest").alias("members"))
    labels = apart.select("set_key", "label").distinct()
    again = grid.union(blocks(many)).join(labels.hint("shuffle_hash"), "set_key")
    return told.union(linked(again, "label"))


def blocks(large: DataFrame) -> DataFrame:
    """(key, set_key, n, at) of groups (key, set_key, n, at, members) in blocks of about SMALL rows, so that any two rows of a group meet in one."""
    parts = F.ceil(2 * F.col("members") / SMALL)
    part = F.pmod(F.xxhash64("set_key", F.lit(3)), parts)
    pairs = large.withColumn("i", part).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).filter("i <> j")
    return pairs.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "set_key", "n", "at")


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    return joined_classes(docs, id_col, text_col, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = neardup.oracle(PERCENT, "")
