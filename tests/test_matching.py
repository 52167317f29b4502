"""Matched reads, against plain Python."""

import random

import pytest

from guardwalk.operators import matching


def plain(masters, transactions):
    out = [(k, "no transaction", None, v, None) for k, v in masters if k is None] + [(k, "no master", None, None, (v, w)) for k, v, w in transactions if k is None]
    for key in {x[0] for x in masters + transactions} - {None}:
        ms = sorted((v for k, v in masters if k == key), key=lambda v: (v is not None, v or ""))
        ts = sorted(((v, w) for k, v, w in transactions if k == key), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
        out += [(key, "duplicate master", i, v, None) for i, v in enumerate(ms, 1) if i > 1]
        out += [(key, "no transaction", None, ms[0], None)] if ms and not ts else []
        out += [(key, "matched" if ms else "no master", i, ms[0] if ms else None, x) for i, x in enumerate(ts, 1)]
    return sorted(out, key=repr)


def run(spark, masters, transactions):
    m, t = spark.createDataFrame(masters, "id long, value string"), spark.createDataFrame(transactions, "id long, at long, value string")
    got = matching.balance_line(m, t, "id", ["at"]).collect()
    return sorted(((x["id"], x["side"], x["occurrence"], x["master"] and x["master"]["value"], x["transaction"] and (x["transaction"]["at"], x["transaction"]["value"])) for x in got), key=repr)


@pytest.mark.parametrize("hot", [0, 2000])
def test_balance_line(spark, hot):
    """Duplicates, nulls, ties, unmatched rows of both files; a hot key whose equal rows lie in several ranges."""
    g = random.Random(hot)
    masters = [(g.choice([None, *range(12)]), g.choice(["a", "b", "c"])) for _ in range(25)]
    transactions = [(g.choice([None, *range(5, 20)]), g.choice([None, 1, 2, 3]), g.choice(["x", "y", None])) for _ in range(80)] + [(7, 1, "z")] * hot
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, masters, transactions) == plain(masters, transactions)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_files(spark):
    assert run(spark, [], []) == [] and run(spark, [(1, "a")], []) == [(1, "no transaction", None, "a", None)] and run(spark, [], [(1, 2, "b")]) == [(1, "no master", 1, None, (2, "b"))]
