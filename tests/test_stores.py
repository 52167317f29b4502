"""Stores and streams on small cases."""

import json

from guardwalk.sources import program, stores
from guardwalk.streaming import delivery

W = stores.WITNESS


def test_ledger_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("P", 1, "IF", True, "r1", 5)], W)
    b = spark.createDataFrame([("P", 1, "IF", True, "r0", 7), ("P", 1, "IF", False, "r2", 6)], W)
    stores.write_witnesses(stores.credit(a, b), str(tmp_path / "w"))
    got = {(r["direction"], r["recipe"]) for r in stores.read_witnesses(spark, str(tmp_path / "w")).collect()}
    assert got == {(True, "r1"), (False, "r2")}


def test_journal_latest_wins(spark, tmp_path):
    for seq, v in ((1, "a"), (2, "b")):
        stores.append_journal(spark.createDataFrame([(seq, "bind", "S", v, None)], stores.JOURNAL), str(tmp_path / "j"))
    assert [r["value"] for r in stores.journal_bindings(spark, str(tmp_path / "j")).collect()] == ["b"]


def test_profile(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"version": "1.4", "name": "h", "extra": 1, "injectable": ["A"], "operations": [{"op": "READ:ACCT", "aliases": ["get acct"], "fields": ["ST"]}]}))
    p = stores.read_profile(spark, str(tmp_path / "p.json"))
    calls = spark.createDataFrame([("READ:ACCT",), ("read-acct",), ("GET:ACCT",), ("X",)], "op string")
    assert {r["op"]: r["tier"] for r in stores.resolve_operations(calls, p).collect()} == {"READ:ACCT": "exact", "read-acct": "canonical", "GET:ACCT": "alias", "X": "none"}
    b = spark.createDataFrame([("p", "s1", None, "A"), ("p", "s2", None, "B"), ("p", "s3", "READ:ACCT", "ST"), ("p", "s4", "READ:ACCT", "X"), ("p", "s5", "Z", "X")], "plan string, slot string, op string, field string")
    assert sorted(r["slot"] for r in stores.unrepresentable(b, p).collect()) == ["s2", "s4", "s5"]


def test_sources(spark, tmp_path):
    text = "       PROGRAM-ID. X.\n       DATA DIVISION.\n       01 A PIC 9.\n          88 ON-A VALUE 1 THRU 3 7.\n      * comment\n       PROCEDURE DIVISION.\n       P-1.\n           IF A = 1 PERFORM P-2 ELSE GO TO P-3 END-IF.\n       P-2.\n           EXIT.\n       P-3.\n           GOBACK.\n"
    (tmp_path / "x.cbl").write_text(text)
    src = stores_read = program.read_sources(spark, str(tmp_path))
    assert stores_read.count() == 1
    got = {(r["caller"], r["callee"], r["kind"], tuple(r["guards"])) for r in program.edges(src).collect()}
    assert got == {("P-1", "P-2", "perform", ("A = 1",)), ("P-1", "P-3", "goto", ("NOT ( A = 1 )",)), ("P-1", "P-2", "fallthrough", ()), ("P-2", "P-3", "fallthrough", ())}
    assert program.parse_program(text).names88 == {"ON-A": ("A", [(1, 3), 7])}


def test_delivery_stream(spark, tmp_path):
    calls = spark.createDataFrame([("R", i) for i in range(4)] + [("W", 9)], "op string, call_id long")
    calls.write.parquet(str(tmp_path / "c"))
    s = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "c"))
    q = delivery.deliver(s, {"R": ["00", "10"]}, "end").writeStream.format("memory").queryName("delivered").option("checkpointLocation", str(tmp_path / "k")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["op"], r["n"], r["outcome"]) for r in spark.table("delivered").collect())
    assert got == [("R", 1, "00"), ("R", 2, "10"), ("R", 3, "end"), ("R", 4, "end"), ("W", 1, "end")]


def test_ledger_stream(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.createDataFrame([("P", 1, "IF", True, "r1", 5), ("P", 1, "IF", True, "r0", 4)], W).write.parquet(src)
    q = delivery.keep_ledger(spark.readStream.schema(W).parquet(src), str(tmp_path / "l"), str(tmp_path / "k"))
    q.processAllAvailable()
    q.stop()
    assert [r["recipe"] for r in spark.read.parquet(str(tmp_path / "l" / "v0")).collect()] == ["r0"]
