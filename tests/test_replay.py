"""Numbers, runs, replayed series and their stream, against plain Python."""

import random
from itertools import groupby

import pytest

from guardwalk.operators import replay, sequences
from guardwalk.session import Rounds
from guardwalk.streaming import delivery


@pytest.mark.parametrize("hot", [0, 3000])
def test_runs(spark, hot):
    """Null keys and values, ties; a hot key that lies in several ranges."""
    g = random.Random(hot)
    rows = [(g.choice([None, 1, 2, 3]), g.choice([None, *range(30)]), g.choice([None, True, False]), i) for i in range(200)] + [(2, g.randrange(40, 60), g.random() < 0.5, -i) for i in range(hot)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sequences.runs(spark.createDataFrame(rows, "k long, at long, v boolean, i long"), "k", ["at", "i"], "v", Rounds(spark)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    low = lambda x: (x is not None, x or 0)
    want = []
    for _, own in groupby(sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[3])), key=lambda r: r[0]):
        call = 0
        for run, (_, same) in enumerate(groupby(own, key=lambda r: r[2]), 1):
            for j, r in enumerate(same):
                call += 1
                want.append((*r, call, run, j == 0))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


class Counted(Rounds):
    """Notes how many rows each cut writes."""

    def __init__(self, spark):
        super().__init__(spark)
        self.rows = []

    def cut(self, df):
        out = super().cut(df)
        self.rows.append(out.count())
        return out


def test_only_hot_keys_go_by_ranges(spark, monkeypatch):
    """Rows of other keys aren't written between; where hot keys (null among them) lie in ranges, numbers and runs are those of one sort."""
    g = random.Random(7)
    rows = [(g.choice([None, None, 1, 1, 1, 2, 3]), g.randrange(20), g.choice([None, True, False]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, at long, v boolean, i long")
    plain = Counted(spark)
    want = sorted(map(tuple, sequences.runs(df, "k", ["at"], "v", plain).collect()), key=repr)
    assert sum(plain.rows) == 0 and len(want) == 600
    monkeypatch.setattr(sequences, "HOT", 120)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = Counted(spark)
        got = sorted(map(tuple, sequences.runs(df, "k", ["at"], "v", hot).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    n = sum(k in (None, 1) for k, *_ in rows)
    assert hot.rows == [2, n, n]


PLANNED, PROFILE = "op string, at long, set map<string,string>", "op string, fields array<string>, most int"
OUTCOMES = [("r", 2, {"x": "2"}), ("R", 1, {"x": "1", "y": "9"}), ("R", 3, {"y": "3"}), ("R", 4, None), ("R", 5, {"X": "5"}), ("R", 6, {"X": "6"}), ("R", 7, {"Y": "7"}), ("W", 1, {"A": "1"}), ("N", 1, {"A": "1"}), (None, 1, {"A": "1"})]
OFFERED = [("R", ["x"], 6), ("W", ["A"], None), ("E", ["A"], 0)]
ENDS = [("R", {"x": "end", "Y": "no"}), ("W", {"Z": "no"}), ("E", {"a": "over"})]


def tables(spark):
    profile = spark.createDataFrame(OFFERED, PROFILE)
    return replay.series(spark.createDataFrame(OUTCOMES, PLANNED), ["at"], profile), replay.endings(spark.createDataFrame(ENDS, "op string, set map<string,string>"), profile)


def test_series(spark):
    held, ends = tables(spark)
    got = sorted((x["op"] or "", x["call"], x["status"], x["set"], x["refused"], x["run"]) for x in held.collect())
    assert got == [("", 1, "no operation", {}, ["A"], 1), ("N", 1, "no operation", {}, ["A"], 1),
                   ("R", 1, "kept", {"X": "1"}, ["Y"], 1), ("R", 2, "kept", {"X": "2"}, [], 1), ("R", 3, "empty", {}, ["Y"], 2), ("R", 4, "empty", {}, [], 2),
                   ("R", 5, "kept", {"X": "5"}, [], 3), ("R", 6, "kept", {"X": "6"}, [], 3), ("R", 7, "beyond", {}, ["Y"], None), ("W", 1, "kept", {"A": "1"}, [], 1)]
    assert {x["op"]: x["terminal"] for x in ends.collect()} == {"R": {"X": "end"}, "E": {"A": "over"}}


def test_stream_equals_batch(spark, tmp_path):
    """Three micro-batches; calls beyond the series, of unknown operations, and of one that only has an ending."""
    held, ends = tables(spark)
    calls = [("R", i) for i in range(4)] + [("W", 4), ("E", 5), ("Q", 6)] + [("r", i) for i in range(7, 12)] + [("W", 12), ("E", 13)]
    df = spark.createDataFrame(calls, "op string, call_id long")
    batch = {x["called"]["call_id"]: (x["called"]["op"].upper(), x["call"], x["source"], x["set"]) for x in replay.replayed(df, ["call_id"], held, ends).collect()}
    assert batch[8] == ("R", 6, "outcome", {"X": "6"}) and batch[9] == ("R", 7, "terminal", {"X": "end"}) and batch[2] == ("R", 3, "outcome", {}) and batch[12] == ("W", 2, "none", None) and batch[6] == ("Q", 1, "none", None)
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for lo in (0, 5, 10):
            df.filter(f"call_id >= {lo} AND call_id < {lo + 5}").coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
            q = delivery.replay(spark.readStream.schema(df.schema).parquet(str(tmp_path / "c")), held, ends).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
            q.awaitTermination(100)
        got = {x["call_id"]: (x["op"], x["call"], x["source"], x["set"]) for x in spark.read.parquet(str(tmp_path / "o")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == batch


def test_empty_tables(spark):
    none = spark.createDataFrame([], PROFILE)
    held = replay.series(spark.createDataFrame([], PLANNED), ["at"], none)
    ends = replay.endings(spark.createDataFrame([], "op string, set map<string,string>"), none)
    assert held.count() == 0 and ends.count() == 0
    assert [x["source"] for x in replay.replayed(spark.createDataFrame([("A", 1)], "op string, call_id long"), ["call_id"], held, ends).collect()] == ["none"]


def test_hot_operations_get_the_same(spark, monkeypatch):
    """Calls and outcomes of an operation that lies in ranges, with and without an ending."""
    held, ends = tables(spark)
    calls = spark.createDataFrame([(op, i) for i, op in enumerate([*"RRrRRRRRRR", "W", None, *"QQQQQQ", "E", None])], "op string, call_id long")
    rows = lambda held: sorted((repr(x.asDict(True)) for x in replay.replayed(calls, ["call_id"], held, ends).collect()))
    want = rows(held)
    monkeypatch.setattr(sequences, "HOT", 4)
    again, _ = tables(spark)
    assert sorted(repr(x.asDict(True)) for x in again.collect()) == sorted(repr(x.asDict(True)) for x in held.collect())
    assert rows(again) == want and sum("terminal" in x for x in want) == 5
