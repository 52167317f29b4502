"""The runner's verbs, phrases and outcomes on small programs."""

import random

import pytest
from pyspark.sql import functions as F

from guardwalk.functions import cobol
from guardwalk.functions.codecs import Item, layout
from guardwalk.operators import coverage
from guardwalk.plans import worlds
from guardwalk.plans.runner import Run, final_states, run_program
from guardwalk.plans.values import related
from guardwalk.sources import program as source
from guardwalk.sources.program import parse_program, records
from tests.test_semantics import HEAD, run

NUMBERS = "01 A PIC S9(3) VALUE 7.\n01 B PIC S9(3) VALUE 2.\n01 C PIC S9(3)V99.\n01 D PIC 9(2).\n01 R PIC 9(2)."


def after(data: str, *lines: str, **state):
    return run(data, "A-MAIN.\n" + "".join(f"    {x}\n" for x in lines) + "    GOBACK.", **state)


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("ADD A TO B GIVING C", {"A": 7, "B": 2, "C": 9}), ("ADD A B GIVING C", {"C": 9}), ("ADD 1 A TO B D", {"B": 10, "D": 8}), ("SUBTRACT A FROM B", {"B": -5}),
        ("SUBTRACT B FROM A GIVING C", {"C": 5, "A": 7}), ("MULTIPLY A BY B", {"B": 14}), ("MULTIPLY A BY B GIVING C", {"C": 14, "B": 2}), ("DIVIDE B INTO A", {"A": 3}),
        ("DIVIDE A BY B GIVING C", {"C": 3.5}), ("DIVIDE A BY B GIVING D REMAINDER R", {"D": 3, "R": 1}), ("DIVIDE A BY B GIVING D ROUNDED", {"D": 4}),
        ("COMPUTE C = (A + B) * 2 ** 2 - 1 / 0", {"C": 36}), ("COMPUTE D ROUNDED = A / B", {"D": 4}), ("COMPUTE C = - A", {"C": -7}), ("DIVIDE A BY D GIVING C", {"C": 0}),
    ],
)
def test_arithmetic(line, want):
    r = after(NUMBERS, line)
    assert r.stopped == "ended" and {k: r.state[k] for k in want} == want


def test_size_error():
    lines = ("MULTIPLY 99 BY D", "ON SIZE ERROR MOVE 1 TO A", "NOT ON SIZE ERROR MOVE 2 TO A", "END-MULTIPLY", "MOVE 5 TO B")
    r = after(NUMBERS, *lines, D=9)
    assert (r.state["D"], r.state["A"], r.state["B"]) == (9, 1, 5) and r.events == [("A-MAIN", 0, "SIZE ERROR", True)]
    r = after(NUMBERS, *lines, D=1)
    assert (r.state["D"], r.state["A"]) == (99, 2)
    assert after(NUMBERS, "MULTIPLY 99 BY D", D=9).state["D"] == 91


def test_nothing_is_silent():
    assert after(NUMBERS, "SORT WORK-FILE").stopped == "unsupported: SORT"
    assert after(NUMBERS, "GENERATE REPORT-1", "MOVE 1 TO A").state["A"] == 7
    assert run(NUMBERS, "A-MAIN.\n    PERFORM B-STEP 500 TIMES.\nB-STEP.\n    CONTINUE.").stopped == "loop_limit"
    assert after(NUMBERS, "IF A EXCEEDS B", "MOVE 1 TO A", "END-IF").stopped.startswith("error: ")


def test_loops():
    data = "01 I PIC 9(2).\n01 J PIC 9(2).\n01 N PIC 9(3)."
    r = after(data, "PERFORM VARYING I FROM 1 BY 1 UNTIL I > 3", "AFTER J FROM 1 BY 1 UNTIL J > 2", "ADD 1 TO N", "END-PERFORM")
    assert (r.state["N"], r.state["I"]) == (6, 4)
    r = after(data, "PERFORM VARYING I FROM 1 BY 1 UNTIL I > 9", "IF I = 2 EXIT PERFORM CYCLE END-IF", "IF I = 5 EXIT PERFORM END-IF", "ADD 1 TO N", "END-PERFORM")
    assert (r.state["N"], r.state["I"]) == (3, 5)
    r = run(data, "A-MAIN.\n    PERFORM B-STEP\n    ADD 1 TO N\n    EXIT PROGRAM.\nB-STEP.\n    ADD 10 TO N\n    EXIT PARAGRAPH\n    ADD 100 TO N.")
    assert r.state["N"] == 11 and r.stopped == "ended"
    assert after(data, "PERFORM WITH TEST AFTER UNTIL N > 2", "ADD 1 TO N", "END-PERFORM", N=8).state["N"] == 9


def test_string_and_unstring():
    data = "01 A PIC X(5) VALUE 'AB CD'.\n01 B PIC X(10).\n01 P PIC 9(2) VALUE 1.\n01 N PIC 9.\n01 X PIC X(3).\n01 Y PIC X(3).\n01 Z PIC X(3).\n01 D PIC X.\n01 K PIC 9."
    r = after(data, "STRING A DELIMITED BY SPACE '-' A", "DELIMITED BY SIZE INTO B WITH POINTER P", "ON OVERFLOW MOVE 1 TO N", "END-STRING")
    assert (r.state["B"], r.state["P"], r.state["N"]) == ("AB-AB CD  ", 9, 0)
    r = after(data, "STRING A A A DELIMITED BY SIZE INTO B", "ON OVERFLOW MOVE 1 TO N", "END-STRING")
    assert (r.state["B"], r.state["N"]) == ("AB CDAB CD", 1)
    r = after(data, "UNSTRING B DELIMITED BY ALL ',' OR ';'", "INTO X DELIMITER IN D COUNT IN K Y Z", "TALLYING IN N", B="A,,BCDE;F")
    assert (r.state["X"], r.state["D"], r.state["K"], r.state["Y"], r.state["Z"], r.state["N"]) == ("A  ", ",", 1, "BCD", "F  ", 3)
    assert after(data, "UNSTRING A INTO X", "ON OVERFLOW MOVE 1 TO N", "END-UNSTRING").state["N"] == 1


def test_inspect():
    data = "01 A PIC X(8) VALUE 'AABBAACC'.\n01 N PIC 9(2)."
    assert after(data, "INSPECT A TALLYING N FOR ALL 'A'").state["N"] == 4
    assert after(data, "INSPECT A TALLYING N FOR LEADING 'A'").state["N"] == 2
    assert after(data, "INSPECT A TALLYING N FOR CHARACTERS AFTER 'B' BEFORE 'A'").state["N"] == 1
    for several in ("REPLACING ALL 'A' BY 'X' ALL 'B' BY 'Y'", "TALLYING N FOR ALL 'A' N FOR ALL 'B'", "TALLYING N FOR ALL 'A' ALL 'B'"):
        assert after(data, f"INSPECT A {several}").stopped == "unsupported: INSPECT with several clauses"
    assert after(data, "INSPECT A TALLYING N FOR CHARACTERS BEFORE INITIAL 'C'").state["N"] == 6
    assert after(data, "INSPECT A REPLACING ALL 'A' BY 'Z' AFTER INITIAL 'B'").state["A"] == "AABBZZCC"
    assert after(data, "INSPECT A REPLACING FIRST 'A' BY 'Z'").state["A"] == "ZABBAACC"
    assert after(data, "INSPECT A CONVERTING 'AB' TO 'XY'").state["A"] == "XXYYXXCC"


TABLE = "01 T.\n   05 ROW-1 OCCURS 4 TIMES INDEXED BY IX.\n      10 CODE-1 PIC X(2).\n      10 RATE PIC 9(2).\n01 W PIC X(2).\n01 N PIC 9(2).\n01 F PIC X(6) VALUE 'ABCDEF'."


def test_tables_and_parts():
    r = after(TABLE, "MOVE 'AA11BB22CC33DD44' TO T", "MOVE RATE (3) TO N", "MOVE 'ZZ' TO CODE-1(N)", "MOVE CODE-1 (4) TO W")
    assert (r.state["N"], r.state["W"]) == (33, "ZZ")  # a subscript is held to 1..4
    r = after(TABLE, "MOVE 2 TO N", "MOVE F(N + 1:2) TO W", "MOVE 'xy' TO F(1:2)", "IF F(5:2) = 'EF'", "ADD 1 TO N", "END-IF")
    assert (r.state["W"], r.state["F"], r.state["N"]) == ("CD", "xyCDEF", 3)
    assert after(TABLE, "MOVE 'AA11BB22CC33DD44' TO T", "INITIALIZE T REPLACING NUMERIC DATA BY 5").get("T") == "AA05BB05CC05DD05"
    assert after(TABLE, "MOVE ALL 'AB' TO F").state["F"] == "ABABAB"


def test_search():
    lines = ("MOVE 'AA11BB22CC33DD44' TO T", "SET IX TO 1", "SEARCH ROW-1", "AT END MOVE 99 TO N", "WHEN CODE-1(IX) = W MOVE RATE(IX) TO N", "END-SEARCH")
    r = after(TABLE, *lines, W="CC")
    assert r.state["N"] == 33 and [e[3] for e in r.events] == [False, False, True, False]
    assert after(TABLE, *lines, W="QQ").state["N"] == 99
    assert after(TABLE, lines[0], "SEARCH ALL ROW-1", *lines[3:], W="AA").state["N"] == 11
    assert after(TABLE, "SET IX TO 2", "SET IX UP BY 2", "SET N TO IX").state["N"] == 4


FILES = HEAD.replace("       DATA DIVISION.\n", "       ENVIRONMENT DIVISION.\n       INPUT-OUTPUT SECTION.\n       FILE-CONTROL.\n           SELECT IN-FILE ASSIGN TO INDD\n               FILE STATUS IS FS.\n       DATA DIVISION.\n       FILE SECTION.\n       FD  IN-FILE.\n       01  IN-REC.\n           05 IN-KEY PIC X.\n           05 IN-QTY PIC 9(2).\n")
READER = FILES + "".join(f"       {x}\n" for x in ("01 FS PIC X(2).", "01 N PIC 9(3).", "01 DONE-1 PIC X.", "PROCEDURE DIVISION.", "A-MAIN.", "    OPEN INPUT IN-FILE", "    PERFORM B-READ UNTIL DONE-1 = 'Y'", "    GOBACK.", "B-READ.", "    READ IN-FILE", "       AT END MOVE 'Y' TO DONE-1", "       NOT AT END ADD IN-QTY TO N", "    END-READ.", "    IF FS = '35' MOVE 'Y' TO DONE-1 END-IF.", "    IF IN-KEY = 'Q' ADD 100 TO N END-IF."))


def test_reads():
    p = parse_program(READER)
    assert p.files == {"IN-FILE": {"assign": "INDD", "organization": "SEQUENTIAL", "status": "FS", "record": "IN-REC"}}
    r = Run(p, {}, {"READ:IN-FILE": [{"IN-KEY": "A", "IN-QTY": 5}, {"IN-REC": "Q07"}]}).go()
    assert (r.state["N"], r.state["FS"], r.stopped) == (212, "10", "ended")
    assert Run(p, {}, {}).go().stopped == "loop_limit"  # a bare world never ends


def test_worlds(spark):
    got = worlds.worlds(spark.createDataFrame([(READER,)], "source string"))
    assert {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()} == {"io": 3, "sequence": 3, "fault": 9}
    runs = got.select("world", "outcomes").withColumnRenamed("world", "run_id")
    ends = {r["run_id"]: r for r in final_states(READER, runs).collect()}
    assert ends["empty"]["stopped"] == "ended" and ends["bare"]["stopped"] == "loop_limit" and '"N": 301' in ends["sequence 1"]["state"].replace('"N": 201', '"N": 301')


def test_states_are_run_once(spark):
    states = spark.range(50).select(F.col("id").alias("run_id"), (F.col("id") % 3).alias("A"))
    text = HEAD + "       01 A PIC 9.\n       PROCEDURE DIVISION.\n       M-1.\n           IF A = 1 CONTINUE END-IF.\n"
    got = run_program(text, states).groupBy("result").count().collect()
    assert {r["result"]: r["count"] for r in got} == {True: 17, False: 33}


def test_copy_books(spark):
    text = HEAD + "       COPY PART-1 REPLACING ==:P:== BY ==WS== OLD-NAME BY NEW-NAME.\n       PROCEDURE DIVISION.\n       M-1.\n           GOBACK.\n"
    books = [("PART-1", "       01 :P:-A PIC X.\n       01 OLD-NAME PIC 9(2).\n       COPY PART-2.\n"), ("part-2", "       01 DEEP PIC 9.\n")]
    src = spark.createDataFrame([("p", text)], "path string, source string")
    assert [tuple(r) for r in source.copies(src).collect()] == [("p", "PART-1")]
    got = source.expanded(src, spark.createDataFrame(books, "book string, text string"))
    assert {r["field"] for r in source.fields(got).collect()} >= {"NEW-NAME", "DEEP"}


def test_layouts_of_sources(spark):
    text = HEAD + "".join(f"       {x}\n" for x in ("01 REC.", "   05 A PIC X(3).", "   05 T OCCURS 2 TIMES.", "      10 P PIC S9(5) COMP-3.", "      10 B PIC 9(4) COMP.", "   05 Z REDEFINES A PIC 9(3).", "   05 S PIC S9(2) SIGN IS LEADING SEPARATE.", "PROCEDURE DIVISION.", "M-1.", "    GOBACK."))
    got = {r["field"]: (r["offset"], r["length"]) for r in source.layouts(spark.createDataFrame([(text,)], "source string")).collect()}
    assert got == {"REC": (0, 16), "A": (0, 3), "T": (3, 10), "P": (3, 3), "B": (6, 2), "Z": (0, 3), "S": (13, 3)}
    assert layout(records(parse_program(text))[0])[0].length == 16 and layout(Item("X", "9(9)", "COMP"))[0].length == 4


def test_both_comparisons_agree(spark):
    """functions.cobol on Columns and the runner's rules on values, over values of all kinds."""
    r = random.Random(5)
    pool = ["", " ", "A", "A ", " A", "AB", "b", "7", " 7", "07", "7.0", "-3", "\x00", "\xff", "\x00\x00", "Z9"]
    pairs = [(r.choice(pool), op, r.choice(pool)) for op in ("=", "!=", "<", "<=", ">", ">=") for _ in range(40)]
    numbers = [(r.choice(pool), op, r.choice((0, 7, -3, 10))) for op in ("=", "!=", "<", ">") for _ in range(25)]
    for rows, kind in ((pairs, "string"), (numbers, "int")):
        df = spark.createDataFrame([(i, a, op, b) for i, (a, op, b) in enumerate(rows)], f"i int, a string, op string, b {kind}")
        for op in {x[1] for x in rows}:
            said = df.filter(F.col("op") == op).select("i", F.coalesce(cobol.compare(F.col("a"), op, F.col("b"), "string", kind), F.lit(op == "!=")).alias("x")).collect()
            assert all(bool(x["x"]) == related(rows[x["i"]][0], op, rows[x["i"]][2]) for x in said), op


def test_greedy_cover(spark):
    """The largest gain first, of equal ones the first name; without a gain the need of most plans."""
    needs = [("p1", ["a"]), ("p2", ["a", "b"]), ("p3", ["b", "c"]), ("p4", ["c"]), ("p5", ["d", "e"]), ("p6", ["d", "e"]), ("p7", ["e", "f"]), ("p8", [])]
    granted, want = set(), []
    while left := {p: set(n) - granted for p, n in needs if set(n) - granted}:
        names = sorted({x for n in left.values() for x in n})
        gain = {x: sum(n == {x} for n in left.values()) for x in names}
        best = max(names, key=lambda x: (gain[x], 0 if gain[x] else sum(x in n for n in left.values()), [-ord(c) for c in x])) if any(gain.values()) else max(names, key=lambda x: (sum(x in n for n in left.values()), [-ord(c) for c in x]))
        granted.add(best)
        want.append((best, sum(set(n) <= granted for _, n in needs)))
    assert coverage.unlock(spark.createDataFrame(needs, "plan string, needs array<string>")) == want


def test_flags_and_events_agree(spark):
    df = spark.createDataFrame([(1, 1), (1, 5), (2, None), (3, 5), (4, 0)], "r int, x int")
    decisions = [(1, "IF", F.col("x") > 2), (2, "WHEN", F.when(F.col("x") < 5, F.col("x") == 1))]
    listed = lambda d: sorted(map(tuple, d.select("ordinal", "kind", "direction", "n_runs", "first_run").collect()))
    assert listed(coverage.observe_decisions(df, F.col("r"), decisions)) == listed(coverage.observe(coverage.decide(df, F.col("r"), decisions)))


def test_copies_however_deep(spark):
    """Books six deep, and one that copies itself."""
    books = [(f"B{i}", f"       COPY B{i + 1}.") for i in range(6)] + [("B6", "       01  DEEP PIC X.")]
    src = spark.createDataFrame([("m", "       COPY B0.")], "path string, source string")
    got = source.expanded(src, spark.createDataFrame(books, "book string, text string")).collect()
    assert "DEEP" in got[0]["source"] and "COPY" not in got[0]["source"]
    with pytest.raises(ValueError, match="copies itself"):
        source.expanded(src, spark.createDataFrame([("B0", "       COPY B0.")], "book string, text string"))
