"""Longest stored prefixes, against plain Python."""

import random

from guardwalk.operators import prefixes

SCHEMA = "id long, chain array<string>, ok boolean"


def plain(chain, stored):
    fits = [s for s in stored if chain is not None and s[1] is not None and chain[: len(s[1])] == s[1]]
    return min(fits, key=lambda s: (-len(s[1]), not s[2], s[0]), default=None)


def run(spark, chains, stored):
    a, b = spark.createDataFrame(chains, "id long, chain array<string>"), spark.createDataFrame(stored, SCHEMA)
    got = prefixes.longest_prefix(a, "chain", b, "chain", "ok", ["id"]).collect()
    assert all(x["length"] == (len(x["stored"]["chain"]) if x["stored"] else None) for x in got)
    return sorted((x["asked"]["id"], x["stored"] and x["stored"]["id"]) for x in got)


def want(chains, stored):
    return sorted((i, (plain(c, stored) or [None])[0]) for i, c in chains)


def test_longest_prefix(spark):
    """Few items, so that chains share starts and marks lead past answers; nulls, empties, ties and repeated rows."""
    g = random.Random(5)
    chain = lambda: None if g.random() < 0.03 else [g.choice(["a", "b", None, "", '"a","b"']) if g.random() < 0.15 else "a" for _ in range(g.randrange(0, 22))]
    stored = [(i, chain(), g.choice([True, False, None])) for i in range(150)]
    stored = [s if s[1] else (s[0], None, s[2]) for s in stored]  # no empty chain
    chains = [(i, chain()) for i in range(300)] + [(i, s[1] and s[1] + ["z"]) for i, s in enumerate(stored, 300)]
    chains += chains[:20]
    assert run(spark, chains, stored) == want(chains, stored)


def test_every_length_is_met(spark):
    """A long stored chain, and one of each length below it alone: the search must come back from the long one's marks."""
    stored = [(100, list("a" * 16), True), (7, list("a" * 7), False), (11, list("a" * 11), False)]
    chains = [(n, ["a"] * n + ["b"]) for n in range(18)]
    assert run(spark, chains, stored) == want(chains, stored)


def test_empty_tables_and_chains(spark):
    assert run(spark, [(1, ["a"])], []) == [(1, None)]
    assert run(spark, [], [(1, ["a"], True)]) == []
    assert run(spark, [(1, []), (2, None), (3, ["b"])], [(9, [], True), (8, ["a"], True)]) == [(1, 9), (2, None), (3, 9)]
