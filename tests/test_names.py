"""Qualified names, against plain Python."""

import random

import pytest

from guardwalk.operators import names

F_SCHEMA, R_SCHEMA = "id long, parent long, name string", "id long, status string, path array<string>"


def plain(fields, path):
    if not path or None in path:
        return 0, None
    by, out = {f[0]: f for f in fields}, []
    for i, parent, name in fields:
        above = []
        while parent in by:
            above.append(by[parent][2])
            parent = by[parent][1]
        rest = iter(x and x.upper() for x in above)
        if name and name.upper() == path[0].upper() and all(q.upper() in rest for q in path[1:]):
            out.append(i)
    return len(out), out[0] if len(out) == 1 else None


def run(spark, fields, paths):
    got = names.resolve(spark.createDataFrame([(i, "x", p) for i, p in enumerate(paths)], R_SCHEMA), "path", spark.createDataFrame(fields, F_SCHEMA)).collect()
    assert all(x["status"] == {0: "unknown", 1: "resolved"}.get(x["matches"], "ambiguous") for x in got)
    return [(x["matches"], x["field"]) for x in sorted(got, key=lambda x: x["reference"]["id"])]


def test_resolve(spark):
    """Names that repeat along a path, missing parents, nulls, any case, repeated and wrongly ordered paths."""
    g = random.Random(3)
    pick = lambda: g.choice(["A", "b", "C", "d", "E", "f"])
    fields = [(i, None if i < 4 else g.choice([999, *range(max(0, i - 12), i)]), None if i % 17 == 0 else pick()) for i in range(120)]
    paths = [[pick() for _ in range(g.randrange(1, 6))] for _ in range(250)] + [None, [], ["A", None], ["nowhere"], ["A", "nowhere"]]
    paths += paths[:9]
    assert run(spark, fields, paths) == [plain(fields, p) for p in paths]


def test_parts_and_merge(spark):
    x = spark.createDataFrame([(" a  of b IN c ",), ("OFFICE",), (None,), ("a",)], "t string").select(names.parts("t").alias("path"))
    assert [r[0] for r in x.collect()] == [["A", "B", "C"], ["OFFICE"], None, ["A"]]
    fields = spark.createDataFrame([(1, None, "C"), (2, 1, "B"), (3, 2, "A")], F_SCHEMA)
    assert [tuple(r) for r in names.merged(names.resolve(x, "path", fields), "path").collect()] == [(3, 2, 2)]


def test_empty_tables_and_circles(spark):
    assert run(spark, [], [["A"], ["A", "B", "C"]]) == [(0, None)] * 2 and run(spark, [(1, None, "A")], []) == []
    with pytest.raises(ValueError):
        run(spark, [(1, 2, "A"), (2, 1, "B")], [["A"]])
