"""Domains under constraints, against all assignments."""

import itertools
import operator
import random

from guardwalk.operators import domains

OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
ROWS = "plan string, id string, left string, op string, right string, value long"


def meets(cs, values):
    return all(OPS[op](values[a], values[b] if b is not None else v) for _, _, a, op, b, v in cs)


def possible(cs, names, least, most):
    return [v for v in (dict(zip(names, x, strict=True)) for x in itertools.product(range(least, most + 1), repeat=len(names))) if meets(cs, v)]


def some(seed):
    g = random.Random(seed)
    out = []
    for i in range(g.randrange(2, 8)):
        two = g.random() < 0.5
        a, b = g.sample("ABC", 2)
        out.append((f"p{seed}", f"c{i}", a, g.choice([o for o in OPS if not (two and o == "<>")]), b if two else None, None if two else g.randrange(0, 6)))
    return out


def test_all_assignments(spark):
    plans = {f"p{s}": some(s) for s in range(120)}
    got = domains.solve(spark.createDataFrame([c for cs in plans.values() for c in cs], ROWS), 0, 5).collect()
    broken = 0
    for plan, cs in plans.items():
        names = sorted({n for c in cs for n in (c[2], c[4]) if n})
        every = possible(cs, names, 0, 5)
        mine = [x for x in got if x["plan"] == plan]
        if every:
            assert {x["field"]: (x["lo"], x["hi"]) for x in mine} == {n: (min(v[n] for v in every), max(v[n] for v in every)) for n in names}, (plan, cs)
            assert meets(cs, {x["field"]: x["lo"] for x in mine}) and meets(cs, {x["field"]: x["hi"] for x in mine})
            continue
        broken += 1
        [x] = mine
        part = [c for c in cs if c[1] in x["conflict"]]
        assert len(part) == len(x["conflict"]) and not possible(part, names, 0, 5)
        if not any(c[3] == "<>" for c in part) and not possible(part, names, -3, 9):
            assert all(possible([c for c in part if c is not d], names, -3, 9) for d in part), (plan, x, cs)
    assert 20 < broken < 100


def test_circles_end_at_once(spark):
    """A circle over a domain of 2 * 10^18 values, one that gains nothing, and one that only excluded values move."""
    rows = [("a", "1", "X", "<", "Y", None), ("a", "2", "Y", "<=", "X", None), ("b", "1", "X", "=", "Y", None), ("b", "2", "X", ">=", None, 5), ("b", "3", "X", "<>", None, 5), ("b", "4", "Y", "<>", None, 6), ("c", "1", "X", "<", "X", None)]
    got = domains.solve(spark.createDataFrame(rows, ROWS), -(10**18), 10**18).collect()
    assert sorted((x["plan"], x["field"], x["lo"], x["conflict"]) for x in got if x["plan"] != "b") == [("a", None, None, ["1", "2"]), ("c", None, None, ["1"])]
    assert sorted((x["field"], x["lo"], x["hi"]) for x in got if x["plan"] == "b") == [("X", 7, 10**18), ("Y", 7, 10**18)]


def test_rows_that_are_not_taken(spark):
    rows = [("a", "1", "X", "<>", "Y", None), ("a", "2", "X", "~", None, 1), ("a", "3", "X", "=", None, None), (None, "4", "X", "=", None, 1), ("a", "5", None, "=", None, 1), ("a", "6", "X", None, None, 1), ("a", "7", "X", "=", None, 1)]
    c = spark.createDataFrame(rows + rows[-1:], ROWS).withColumn("bound", domains.F.lit("a clashing name"))
    assert sorted(x["id"] for x in domains.unread(c).collect()) == ["1", "2", "3", "4", "5", "6"]
    assert [tuple(x) for x in domains.solve(c, 0, 9).collect()] == [("a", "X", 1, 1, None)]
    assert domains.solve(c.limit(0), 0, 9).count() == 0


def test_conflicts_lead_over_final_bounds(spark):
    """Z first passes 6, as Y is 5; when Y has risen to 6 it leads to 7 directly, and what excludes 6 has no part in the conflict."""
    rows = [("a", "1", "X", ">", None, 4), ("a", "2", "X", "<", "Y", None), ("a", "3", "Y", ">", None, 4), ("a", "4", "Y", "<", "Z", None), ("a", "5", "Z", "<>", None, 6), ("a", "6", "Z", "<=", None, 6)]
    assert [x["conflict"] for x in domains.solve(spark.createDataFrame(rows, ROWS), 0, 60).collect()] == [["1", "2", "4", "6"]]


def test_small_plans_take_one_pass(spark, monkeypatch):
    """A chain of 40 fields isn't climbed a round at a time, a file or three per round; a plan of more rows than a task takes at once is."""
    rows = [(f"p{p}", f"c{k:02}", f"F{k:02}", "<", f"F{k + 1:02}", None) for p in range(30) for k in range(39)] + [(f"p{p}", "own", f"F{p:02}", ">", None, 30) for p in range(30)]
    files = []
    cut = domains.Rounds.cut
    monkeypatch.setattr(domains.Rounds, "cut", lambda self, df: files.append(1) or cut(self, df))
    c = spark.createDataFrame(rows, ROWS)
    got = sorted(domains.solve(c, 0, 60).collect(), key=str)
    assert len(files) <= 5
    assert {x["plan"]: x["conflict"] for x in got if x["conflict"]} == {f"p{p}": [*(f"c{k:02}" for k in range(p, p + 30)), "own"] for p in range(10)}
    assert [(x["lo"], x["hi"]) for x in got if x["plan"] == "p20" and x["field"] in ("F00", "F19", "F20", "F39")] == [(0, 21), (19, 40), (31, 41), (50, 60)]
    monkeypatch.setattr(domains, "SMALL", 50)
    large = [("q", f"c{k:02}", f"F{k % 3}", "<", None, k) for k in range(60, 1, -1)] + [("q", "up", "F0", "<", "F2", None)]
    both = domains.solve(c.union(spark.createDataFrame(large, ROWS)), 0, 60).collect()
    assert sorted((x for x in both if x["plan"] != "q"), key=str) == got
    assert sorted((x["field"], x["lo"], x["hi"]) for x in both if x["plan"] == "q") == [("F0", 0, 0), ("F1", 0, 3), ("F2", 1, 1)]


def test_one_pass_says_what_rounds_say(spark, monkeypatch):
    """Plans that go over batches' ends, with circles, excluded values and ties; what the pass doesn't leave is the rounds' answer."""
    monkeypatch.setattr(domains.settled, "ROWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        c = spark.createDataFrame([c for s in range(300, 500) for c in some(s)], ROWS)
        for by in ("plan", "CAST(substr(plan, 2) AS int)"):
            x = c.withColumn("plan", domains.F.expr(by))
            one = domains.settled.settle(x, 0, 5).collect()
            left = {r["plan"] for r in one if r["left"]}
            r = domains.Rounds(spark)
            every = domains._by_rounds(x, 0, 5, r).collect()
            r.close()
            assert len(left) < 60
            assert {r["plan"] for r in one} == {r["plan"] for r in every}
            assert sorted((tuple(r)[:5] for r in one if not r["left"]), key=str) == sorted((tuple(r) for r in every if r["plan"] not in left), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
