"""Semantics rules on small cases, and the catalogue against its SQL on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from guardwalk.functions import cobol, codecs
from guardwalk.functions.conditions import condition, dnf, parse
from guardwalk.operators import graph
from guardwalk.plans import catalogue
from guardwalk.plans.runner import Run
from guardwalk.plans.solver import plans
from guardwalk.sources.program import parse_program

HEAD = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. T.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n"


def run(data: str, body: str, **state) -> Run:
    text = HEAD + "".join(f"       {x}\n" for x in data.split("\n")) + "       PROCEDURE DIVISION.\n" + "".join(f"       {x}\n" for x in body.strip("\n").split("\n"))
    return Run(parse_program(text), {k.replace("_", "-"): v for k, v in state.items()}).go()


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "op", "b", "want"), [("AB", "=", "AB  ", True), ("  AB", "=", "AB", False), ("A", "<", "B", True), ("\x00", "=", "\x00\x00\x00", True), ("A", "<", "A!", True)])
def test_text_comparison(spark, a, op, b, want):
    assert one(spark, cobol.compare(F.lit(a), op, F.lit(b), "string", "string")) is want


def test_mixed_comparison(spark):
    assert one(spark, cobol.compare(F.lit(" 7 "), "=", F.lit(7), "string", "int"))
    assert not one(spark, cobol.compare(F.lit("x"), "=", F.lit(7), "string", "int"))


@pytest.mark.parametrize(("v", "mode", "want"), [(2.5, "NEAREST-AWAY-FROM-ZERO", 3), (-2.5, "NEAREST-AWAY-FROM-ZERO", -3), (2.5, "NEAREST-EVEN", 2), (2.5, "NEAREST-TOWARD-ZERO", 2), (-2.1, "TOWARD-GREATER", -2), (-2.1, "TOWARD-LESSER", -3), (2.1, "AWAY-FROM-ZERO", 3), (-2.9, "TRUNCATION", -2)])
def test_rounding(spark, v, mode, want):
    assert int(one(spark, cobol.rounded(F.lit(v), 0, mode))) == want


@pytest.mark.parametrize(("v", "width", "want"), [(0, 2, "0C"), (-7, 2, "007D"), (123, 2, "123C"), (12345, 2, "345C")])
def test_packed(spark, v, width, want):
    assert one(spark, F.hex(codecs.packed(F.lit(v), width))) == want.rjust(2 * width, "0")
    assert one(spark, codecs.unpacked(codecs.packed(F.lit(v), 3))) == v


@pytest.mark.parametrize("v", [0, 1, -1, 32767, -32768])
def test_binary(spark, v):
    assert one(spark, codecs.unbinary(codecs.binary(F.lit(v), 2), 2)) == v


def test_conditions(spark):
    df = spark.createDataFrame([(i, s) for i in range(5) for s in ("A", "B OR C", "")], "n int, s string")
    f = {"N": (df.n, "int"), "S": (df.s, "string")}
    count = lambda t, **k: df.filter(condition(t, f, **k)).count()
    assert count("N = 1 OR 2") == 6 and count("N > 1 AND < 4") == 6 and count("NOT N > 1") == 6 and count("S = 'B OR C'") == 5
    assert count("N IS NOT GREATER THAN 1 AND (S = 'A' OR N = 0)") == 4 and count("") == 15 and count("S = SPACES") == 5
    assert count("LOW", names88={"LOW": ("N", [(0, 1), 3])}) == 9 and count("N NOT = (1 AND 2)") == 9
    assert len(dnf(parse("NOT (A = 1 AND B = 2)"))) == 2 and len(dnf(parse("(A = 1 OR 2) AND (B = 1 OR 2)"))) == 4


def test_control_flow():
    r = run("01 F PIC X VALUE 'N'.", "A-MAIN.\n    ALTER B-JUMP TO PROCEED TO D-TWO\n    PERFORM B-JUMP\n    GOBACK.\nB-JUMP.\n    GO TO C-ONE.\nC-ONE.\n    GOBACK.\nD-TWO.\n    GOBACK.")
    assert r.entered == ["A-MAIN", "B-JUMP", "D-TWO"]
    r = run("01 J PIC 9(2).", "A-MAIN.\n    PERFORM VARYING J FROM 1 BY 1 UNTIL J > 3\n       PERFORM B-STEP\n    END-PERFORM\n    PERFORM B-STEP 2 TIMES\n    PERFORM C-ONE THRU D-TWO\n    GOBACK.\nB-STEP.\n    CONTINUE.\nC-ONE.\n    GO TO D-TWO.\nX-SKIP.\n    CONTINUE.\nD-TWO.\n    EXIT.")
    assert r.entered == ["A-MAIN"] + ["B-STEP"] * 5 + ["C-ONE", "D-TWO"] and r.state["J"] == 4
    r = run("01 N PIC 9(2) VALUE 7.\n01 K PIC 9 VALUE 2.", "A-MAIN.\n    EVALUATE N\n      WHEN 1 THRU 5\n        PERFORM B-LOW\n      WHEN OTHER\n        PERFORM C-HIGH\n    END-EVALUATE\n    GO TO B-LOW C-HIGH DEPENDING ON K.\nB-LOW.\n    GOBACK.\nC-HIGH.\n    CONTINUE.")
    assert r.entered == ["A-MAIN", "C-HIGH", "C-HIGH"] and r.events == [("A-MAIN", 1, "WHEN", False), ("A-MAIN", 3, "WHEN", True)]


def test_stores_and_arithmetic():
    r = run("01 A PIC 9(2).\n01 B PIC X(3).\n01 C PIC S9(3)V99.\n01 E PIC X.\n   88 DONE VALUE 'Y'.", "A-MAIN.\n    MOVE 123 TO A\n    MOVE 'ABCDE' TO B\n    COMPUTE C = ( 1 + 2 ) * 5 / 0 - 2.257\n    ADD 5 TO A\n    SET DONE TO TRUE\n    GOBACK.")
    assert (r.state["A"], r.state["B"], r.state["C"], r.state["E"]) == (28, "ABC", -2.25, "Y")


def test_limits():
    assert run("01 A PIC 9.", "A-MAIN.\n    PERFORM B UNTIL A = 9\n    GOBACK.\nB.\n    CONTINUE.").stopped == "loop_limit"
    assert run("01 A PIC 9.", "A-MAIN.\n    GO TO A-MAIN.").stopped == "step_limit"


def test_plans(spark):
    text = HEAD + "".join(f"       {x}\n" for x in ("01 A PIC 9(3).", "01 B PIC X(2).", "01 C PIC 9(3).", "PROCEDURE DIVISION.", "M-1.", "    IF A > 5 AND ( B = 'X' OR 'Y' )", "       PERFORM P-2", "    END-IF", "    GOBACK.", "P-2.", "    IF A < 7 AND A NOT = 6 PERFORM P-3 END-IF", "    IF A = C PERFORM P-4 END-IF.", "P-3.", "    EXIT.", "P-4.", "    EXIT.", "P-5.", "    EXIT."))
    got = {r["target"]: r for r in plans(spark.createDataFrame([(text,)], "source string")).collect()}
    assert got["P-2"]["verdict"] == "verified" and got["P-4"]["verdict"] == "verified"
    assert got["P-3"]["verdict"] in ("open", "verified") and got["M-1"]["state"] == "{}"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_catalogue(spark, sf, name):
    assert compare.compare(spark, sf, name).startswith("equal")


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_directions_sees_every_run(spark, sf, tmp_path):
    """A direction that a single run takes isn't missing, whatever that run's id."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet").limit(1)
    runs = [(1, "A", 5.0, "O"), (2, "N", 45.0, "F"), (3, "N", 20.0, "F")]
    for key, flag, quantity, status in runs:
        as_is = {"l_orderkey": key, "l_linenumber": 2, "l_returnflag": flag, "l_quantity": quantity, "l_linestatus": status}
        line.withColumns({c: F.lit(v).cast(line.schema[c].dataType) for c, v in as_is.items()}).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(map(tuple, catalogue.QUERIES["missing_directions"](spark, str(tmp_path)).collect())) == [(6, "LOOP", False), (6, "LOOP", True)]


def test_overpunch_keeps_long_ids(spark, tmp_path):
    ids = [0, 7, 999_999, 1_000_000, 1_000_001, 6_000_000_000_013]
    spark.createDataFrame([(i,) for i in ids], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: (r["d"], r["back"], r["apart"]) for r in catalogue.QUERIES["overpunch"](spark, str(tmp_path)).collect()}
    t = {i: f"{i:013d}" for i in ids}
    assert got == {i: (t[i], i, "+" + t[i]) if i % 2 == 0 else (t[i][:-1] + chr(0x70 + i % 10), -i, "-" + t[i]) for i in ids}
