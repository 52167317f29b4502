"""Whitening, the prefix trie and the n-gram join, held against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from guardwalk.llm import neardup, ngramjoin, trie, whitening
from tests.llm.common import docs, empty, prose, texts

# ---- whitening


def plain_whitening(vectors):
    """(n, {x: deviation}, covariance) of lists of floats, in fractions."""
    kept = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [tuple(math.floor(256 * c) for c in v) for v in kept]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    dev = {x: sum((n * x[i] - s[i]) ** 2 for i in range(d)) for x in fit}
    cov = [[sum(Fraction(n * x[i] - s[i], n) * Fraction(n * x[j] - s[j], n) for x in fit) / n for j in range(d)] for i in range(d)]
    return n, s, dev, cov, fit


VECTORS = "vec_id long, embedding array<float>, x string, n int, w int, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "q", 1, 2, 3) for i, v in rows], VECTORS)


def sample(offset=0.0):
    r = random.Random(3)
    rows = [(i, [offset + r.gauss(0, 1 + k) + (r.random() if k else 0) for k in range(7)]) for i in range(60)]
    rows += [(60, rows[0][1]), (60, rows[0][1]), (None, rows[1][1]), (61, None), (62, [1.0, None] + [0.0] * 5), (63, [float("nan")] * 7), (64, [float("inf")] + [0.0] * 6)]
    return rows


@pytest.mark.parametrize("offset", [0.0, 100_000.0])
def test_whitening_equals_fractions(spark, offset):
    rows = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in sample(offset)]
    n, s, dev, cov, fit = plain_whitening([v for _, v in rows])
    got = whitening.whiten(vectors(spark, rows)).collect()
    whole = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    assert len(got) == 4 * len(whole) and {r["n"] for r in got} == {n}
    f, v = np.array([[float(c) for c in row] for row in cov]), None
    e, v = np.linalg.eigh(f)
    order = np.argsort(-e)[:4]
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r)
    sign = {}
    for i, vec in whole:
        x = tuple(math.floor(256 * c) for c in vec)
        y = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
        for r in by[i]:
            k = order[r["component"] - 1]
            want = y @ v[:, k] / math.sqrt(e[k])
            assert int(r["deviation"]) == dev[x]
            assert sign.setdefault(r["component"], 1 if want * r["whitened"] >= 0 else -1) * want == pytest.approx(r["whitened"], abs=1e-6)
            assert r["explained"] == pytest.approx(e[k] / float(sum(cov[a][a] for a in range(7))), rel=1e-9) and r["identity_error"] < 1e-9


def test_covariance_by_polarisation_is_exact():
    x = np.array([[10**9 + 3, -5, 2**40], [10**9, 7, -(2**40)], [10**9 + 1, 0, 5]], np.int64)
    total = [int(t) for t in x.astype(object).sum(0)]
    middle = [t // 3 for t in total]
    f = whitening.Fit(3, total, {(i, j): s for i, j, s in whitening.squares(x, middle)}, middle, 3)
    want = [[float(sum(Fraction(3 * int(r[i]) - total[i], 3) * Fraction(3 * int(r[j]) - total[j], 3) for r in x) / 3) for j in range(3)] for i in range(3)]
    assert f.cov.tolist() == want
    assert f.deviation(x) == [sum((3 * int(c) - t) ** 2 for c, t in zip(r, total, strict=True)) for r in x]


def test_whitening_of_nothing_and_of_equal_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [float("nan")])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, [])])).count() == 0
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0]), (3, [3.0])])).collect()  # one component has variance; missing entries are zero
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]


def test_whitening_query(spark, sf):
    got = whitening.query(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, s, dev, _, _ = plain_whitening([r["embedding"] for r in rows])
    want = {r["vec_id"]: dev[tuple(math.floor(256 * c) for c in r["embedding"])] for r in rows}
    assert {r["vec_id"]: r["deviation"] for r in got.collect()} == want and got.count() == 4 * len(rows)


# ---- prefix trie

TURNS = "conv_id long, turn long, role string, text string, depth int, key string, place int, n string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "n") for r in rows], TURNS)


def plain_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), order, (role, text)))
    own = {c: [t for *_, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = (own.get(c - c % 5, [])[:h] + ts[h:]) if rebuild else ts
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    sums = {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(sums[x][0] for x in children[k]) or 1
        saved = sum(sums[x][1] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        sums[k] = leaves, saved
    say = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *sums[k], say(k)) for k, m in members.items())


def as_rows(df):
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()), key=lambda r: (r[0], r[1]))


def talk(seed=5, convs=60, long=75):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["a", "bé", "", None, "ccc"])) for c in range(convs) for t in range(r.randrange(1, 7))]
    rows += [(c, t, "user", f"t{t // 3}" if t < 60 + c % 3 else f"{c}") for c in (70, 71, 75, 76, 80) for t in range(long)]
    rows += [(90, None, "user", "x"), (90, None, "bot", "y"), (90, None, "bot", "y"), (90, 0, None, None), (93, 1, "user", "late"), (None, 1, "user", "z"), (10**12, 5, "user", "a")]
    return rows


def key(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize(("block", "height"), [(1024, None), (1024, 32), (16, 16), (32, 16)])
def test_trie_equals_plain_python(spark, monkeypatch, block, height):
    """Also with blocks that long conversations pass, and with several bands."""
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = talk()
    assert as_rows(trie.rebuilt_trie(conversations(spark, rows), height)) == key(plain_trie(rows))
    assert as_rows(trie.plain_trie(conversations(spark, rows), height)) == key(plain_trie(rows, False))


def test_trie_ends_of_many_conversations(spark, monkeypatch):
    """A node at which conversations of many id ranges end: its ids are hashed in numerical order."""
    rows = [(c, 0, "user", "hi") for c in range(0, 9000, 5)]
    assert as_rows(trie.plain_trie(conversations(spark, rows))) == key(plain_trie(rows, False))


def test_trie_of_nothing(spark):
    assert trie.rebuilt_trie(conversations(spark, [])).count() == 0
    assert trie.rebuilt_trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0
    turnless = [(c, 0, "user", "a") for c in (11, 12, 13, 14)]
    assert as_rows(trie.rebuilt_trie(conversations(spark, turnless))) == key(plain_trie(turnless))


# ---- n-gram join

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_join(rows, width=4, percent=85):
    """{(doc_id, n, component)} of (doc_id, text) by comparing everything with everything."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, (i, x) in enumerate(sets):
        for b in range(a):
            j, y = sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(x), least.get(find(a)) if i is not None else None) for a, (i, x) in enumerate(sets)), key=repr)


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def copies(seed, n=40):
    """Groups of copies with few and many changes, passages that many documents share, short texts."""
    r, out = random.Random(seed), []
    for g in range(n // 4):
        base = prose(r.choice([3, 5, 8, 30, 120]), seed * 100 + g).split()
        for _ in range(4):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = f"z{r.randrange(9)}"
            out.append((len(out), " ".join(w)))
    shared = prose(40, seed + 7)
    return out + [(len(out) + k, f"{shared} {prose(r.choice([2, 4, 40]), k)}") for k in range(n // 2)]


@pytest.mark.parametrize(("small", "chunk"), [(512, 256), (4, 4)])
@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, monkeypatch, small, chunk, seed):
    """Also where shingles' groups and candidates' groups are too large for one piece."""
    monkeypatch.setattr(ngramjoin, "SMALL", small)
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rows = copies(seed)
    assert joined(ngramjoin.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == plain_join(rows)


def test_large_groups_of_near_copies_grow_with_their_members(spark, monkeypatch):
    """A hundredth of a shingle's classes resemble each other and not the rest, which do too: rows grow with the classes, and each side becomes one."""
    sent, in_groups = [], ngramjoin.in_groups

    def counted(rows, *more):
        sent.append(rows.count())
        return in_groups(rows, *more)

    monkeypatch.setattr(ngramjoin, "in_groups", counted)
    m, t = 3000, neardup.Tables(spark)
    keys = [(k.to_bytes(2, "big"), bytes([4] * 16 + [0] * 16 if k % 100 else [0] * 16 + [4] * 16)) for k in range(m)]
    reps = spark.createDataFrame(keys, "set_key binary, ranges binary")
    large = reps.selectExpr("7L AS key", "set_key", "64 AS n", "0 AS at", f"{m}L AS members")
    edges = ngramjoin.candidate_links(large.select("key", "set_key", "n", "at").limit(0), large, reps, 85, t.cut)
    links = {tuple(int.from_bytes(bytes(x), "big") for x in e) for e in edges.collect()}
    up = list(range(m))
    for _ in range(4):
        for x, y in links:
            up[x] = up[y] = min(up[x], up[y])
    assert up == [int(k % 100 > 0) for k in range(m)]
    assert sum(sent) < 4 * m  # blocks of all pairs would take 11 rows a class
    t.drop()


def test_join_of_odd_rows(spark):
    rows = [(i, t) for i, t, _ in texts()]
    assert joined(ngramjoin.join_components(docs(spark))) == plain_join(rows)
    assert ngramjoin.join_components(empty(spark)).count() == 0
    assert dict(ngramjoin.join_components(docs(spark)).dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}


def test_prefix_sizes_at_the_bound():
    """Two sets that are just similar enough share a token of their prefixes, whatever the order."""
    r = random.Random(8)
    for _ in range(2000):
        n, m = r.randrange(1, 60), r.randrange(1, 60)
        common = -(-85 * (n + m) // 185)
        if common > min(n, m):
            continue
        both = r.sample(range(1000), n + m - common)
        x, y = both[:n], both[:common] + both[n:]
        first = [set(sorted(s)[: ngramjoin.prefix_size(len(s), 85)]) for s in (x, y)]
        assert 100 * common >= 85 * (n + m - common) and first[0] & first[1]


def test_filters_leave_linked_pairs(spark):
    rows = [r for r in copies(3, 80) if r[1]]
    sets = [np.array(sorted(ngramjoin.Shingler(4)(t)), np.uint64) for _, t in rows]
    told = [(0, bytes([k]), k, s.tobytes()) for k, s in enumerate(sets)]
    f, every = ngramjoin.Suffixed(told, 85), np.arange(len(told))
    for i, x in enumerate(sets):
        want = [j for j, y in enumerate(sets) if (c := len(np.intersect1d(x, y))) and 100 * c >= 85 * (len(x) + len(y) - c)]
        assert [j for j in f.near(i, every).tolist() if j != i] == [j for j in want if j != i]


def test_one_shared_shingle_makes_no_candidates():
    """Unrelated sets that share one rare shingle aren't candidates; sets that are linked always are, whatever their numbers of ranges."""
    r = np.random.default_rng(5)
    draw = lambda n: r.integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
    row = lambda k, s: ("t", bytes([k]), len(s), 0, ngramjoin.ranges_of(s).tobytes())
    for n in (200, 1000, 20_000):
        apart = [np.unique(np.append(draw(n), np.uint64(1))) for _ in range(3)]
        assert ngramjoin.may_link([row(k, s) for k, s in enumerate(apart)], 85) == []
    for n in (1, 2, 7, 100, 511, 512, 530, 5000, 16_000, 40_000):
        s = np.unique(draw(n))
        m = -(-85 * len(s) // 100)
        changed = np.unique(np.append(s[: 46 * len(s) // 50], draw(len(s) // 100)))
        for t in (s[:m], s[len(s) - m :], *([changed] if n >= 100 else [])):
            assert ngramjoin.may_link([row(0, s), row(1, np.sort(t))], 85), (n, len(t))
            assert ngramjoin.may_link([row(0, draw(n)), row(1, np.sort(t)), row(2, s)], 85)


def test_blocks_let_all_rows_of_a_group_meet(spark):
    rows = [(7, k.to_bytes(2, "big"), 9, 0, 1700) for k in range(1700)]
    out = ngramjoin.blocks(spark.createDataFrame(rows, "key long, set_key binary, n int, at int, members long")).collect()
    met, held = set(), {}
    for x in out:
        held.setdefault(x["key"], []).append(int.from_bytes(bytes(x["set_key"]), "big"))
    assert max(map(len, held.values())) < 2 * ngramjoin.SMALL
    for some in held.values():
        met |= {(a, b) for a in some for b in some if a < b}
    assert len(met) == 1700 * 1699 // 2


def test_facts_find_hot_and_other_rows(spark):
    """Keys of each type: hot rows take keys of their own, and every row gets its own group's facts."""
    from guardwalk.llm.hot import join_facts

    for kind in ("binary", "bigint", "string", "int"):
        rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).cast("string" if kind == "binary" else kind).cast(kind).alias("k"))
        facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        out = join_facts(rows, "k", [F.col("id")], facts, "n", 3000)
        assert sorted(map(tuple, out.select("id", "n", "least").collect())) == sorted(map(tuple, rows.join(facts, "k").select("id", "n", "least").collect()))
