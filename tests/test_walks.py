"""Ways through programs and evidence, against plain Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from guardwalk.operators import coverage, evidence, paths
from guardwalk.plans.programs import HEAD
from guardwalk.sources import program as source


def test_on_chain(spark):
    r = random.Random(1)
    rows = []
    for i in range(200):
        chain = r.sample("ABCDEFG", r.randrange(1, 6))
        rows.append((i, r.sample("ABCDEFG", r.randrange(0, 7)), chain))
    df = spark.createDataFrame(rows, "i int, entered array<string>, chain array<string>")
    n, pos, frame = paths.on_chain(F.col("entered"), F.col("chain"))
    for i, n_, pos_, frame_ in df.select("i", n, pos, frame).collect():
        _, entered, chain = rows[i]
        lacking = [(k, x) for k, x in enumerate(chain) if x not in entered]
        assert (n_, pos_, frame_) == (len(set(chain) & set(entered)), *(lacking[0] if lacking else (None, None)))


RECURSIVE = HEAD + """
       01  N PIC 9.
       PROCEDURE DIVISION.
       A-MAIN.
           IF N = 1
              PERFORM B-LOOP
           ELSE
              GOBACK
           END-IF
           IF N = 1
              PERFORM C-OUT
           END-IF
           PERFORM C-OUT
           PERFORM A-MAIN.
       B-LOOP.
           IF N = 2
              PERFORM B-LOOP
              PERFORM C-OUT
           END-IF.
       C-OUT.
           STOP RUN.
"""


def test_survival_with_recursion_and_both_sides_of_a_condition(spark):
    s = source.statements(spark.createDataFrame([(RECURSIVE,)], "source string"))
    got = {(r["paragraph"], r["ordinal"], r["callee"]): (r["obligations"], r["infeasible"]) for r in paths.survival(s).collect()}
    assert got == {
        ("A-MAIN", 1, "B-LOOP"): ([], False),
        ("A-MAIN", 4, "C-OUT"): (["NOT ( N = 2 )"], False),  # B-LOOP ends the run under N = 2; the GOBACK is on the other side
        ("A-MAIN", 5, "C-OUT"): (["NOT ( N = 1 )", "NOT ( N = 1 AND N = 2 )", "NOT ( NOT ( N = 1 ) )"], False),
        ("A-MAIN", 6, "A-MAIN"): (["NOT ( N = 1 )", "NOT ( N = 1 AND N = 2 )", "NOT ( NOT ( N = 1 ) )"], True),
        ("B-LOOP", 1, "B-LOOP"): ([], False),
        ("B-LOOP", 2, "C-OUT"): ([], False),
    }
    order = source.execution_order(spark.createDataFrame([(RECURSIVE,)], "source string")).orderBy("rank").collect()
    assert [r["paragraph"] for r in order] == ["A-MAIN", "B-LOOP", "C-OUT"]


def test_chain_via_a_stop_that_is_not_there(spark):
    e = spark.createDataFrame([("A", "B", 1, []), ("B", "C", 2, [])], "caller string, callee string, seq long, guards array<string>")
    assert [tuple(r) for r in paths.chain_via(e, ["A", "B", "C"]).collect()] == [(2, ["A", "B", "C"])]
    assert paths.chain_via(e, ["A", "C", "B"]).count() == 0


def test_relations(spark):
    holds = {"=": int.__eq__, "<>": int.__ne__, "<": int.__lt__, ">": int.__gt__, "<=": int.__le__, ">=": int.__ge__}
    df = spark.createDataFrame([(o, p) for o in holds for p in (-3, 0, 7)], "op string, pin int")
    for o, p, back, x in df.select("op", "pin", evidence.flipped(F.col("op")), evidence.companion(F.col("op"), F.col("pin"))).collect():
        assert holds[o](x, p) and holds[back](p, x) and all(holds[o](a, b) == holds[back](b, a) for a in range(-2, 3) for b in range(-2, 3))


def test_handover_takes_the_first_run_with_all_values(spark):
    r = random.Random(2)
    posts = [(f"r{i:03d}", {f: str(r.randrange(3)) for f in "ABC"}) for i in range(60)]
    wants = {f"g{k}": {f: str(r.randrange(3)) for f in r.sample("ABC", r.randrange(1, 4))} for k in range(20)} | {"none": {"A": "9"}}
    got = evidence.handover(
        spark.createDataFrame([(i, json.dumps(s)) for i, s in posts], "run_id string, state string"),
        spark.createDataFrame([(g, f, v) for g, w in wants.items() for f, v in w.items()], "guard string, field string, value string"),
    )
    want = {g: next((i for i, s in posts if all(s[f] == v for f, v in w.items())), None) for g, w in wants.items()}
    assert {x["guard"]: x["run_id"] for x in got.collect()} == {g: i for g, i in want.items() if i}


def test_record_group_needs_its_score(spark):
    f = spark.createDataFrame([("WS-CUST-ID",), ("WS-CUST",), ("X",), ("",)], "field string")
    g = spark.createDataFrame([("WS-CUST-REC",), ("WS-CUST-ALT",), ("OTHER",)], "record string")
    assert sorted(map(tuple, evidence.record_group(f, g).collect())) == [("WS-CUST", "WS-CUST-ALT", 2), ("WS-CUST-ID", "WS-CUST-ALT", 2)]


def test_boundaries_of_pictures(spark):
    text = RECURSIVE.replace("01  N PIC 9.", "01  N PIC 9.\n       01  M PIC S9(3)V99 COMP-3.\n       01  G.\n          05 T PIC X(3).")
    got = {(r["field"], r["category"]): r["value"] for r in evidence.boundaries(source.pictures(spark.createDataFrame([(text,)], "source string"))).collect()}
    assert len(got) == 12 and got["M", "overflow"] == "1000" and got["M", "negative-max"] == "-999" and got["T", "trailing-space"] == "AA " and got["T", "over-width"] == "AAAA"


def test_sampled_values(spark):
    pool = ["a", "b", "c"]
    rows = spark.range(50).select("id", evidence.sampled("s", F.col("id"), F.lit("F"), F.array(*map(F.lit, pool))).alias("v"))
    assert all(v == pool[int(hashlib.md5(f"s:{i}:F".encode()).hexdigest()[:8], 16) % 3] for i, v in rows.collect())
    assert sorted(rows.repartition(5).collect()) == sorted(rows.collect())


def test_greedy_cover(spark):
    """Capabilities in the order of their gain; of equal gains the first name, without any the one that is needed most."""
    r = random.Random(3)
    plans = {f"p{i}": set(r.sample("abcdef", r.randrange(1, 4))) for i in range(30)}
    granted, want = set(), []
    while any(n - granted for n in plans.values()):
        left = [n - granted for n in plans.values() if n - granted]
        gain = {x: sum(n == {x} for n in left) for n in left for x in n}
        count = {x: sum(x in n for n in left) for x in gain}
        best = min(gain, key=lambda x: (-gain[x], 0 if gain[x] else -count[x], x))
        granted.add(best)
        want.append((best, sum(n <= granted for n in plans.values())))
    assert coverage.unlock(spark.createDataFrame([(p, sorted(n)) for p, n in plans.items()], "plan string, needs array<string>")) == want


def test_unlock_keeps_a_row_per_set_of_needs(spark, monkeypatch):
    """Plans that need the same are one row of a round."""
    sizes = []
    real = coverage.Rounds.cut

    def cut(self, df):
        out = real(self, df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(coverage.Rounds, "cut", cut)
    plans = [(i, ["a", "b"] if i % 3 else ["b"]) for i in range(60)] + [(100, [])]
    assert coverage.unlock(spark.createDataFrame(plans, "plan long, needs array<string>")) == [("b", 21), ("a", 61)]
    assert sizes == [3, 2, 1]
