"""Origins of bytes, against plain Python that writes byte by byte."""

import random

from guardwalk.operators import lineage

WRITES = "record string, seq long, lo long, hi long, source string, source_lo long"


def plain(writes):
    out = {}
    for record, _, lo, hi, source, at in sorted((w for w in writes if w[0] is not None and w[2] is not None and w[3] is not None and 0 <= w[2]), key=lambda w: (w[1] is not None, w[1] or 0, w[4] is not None, w[4] or "", w[5] - w[2])):
        for i in range(lo, hi):
            out[record, i] = (source, at + i - lo)
    return out


def spread(rows):
    out = {}
    for x in rows:
        assert x["lo"] < x["hi"]
        for i in range(x["lo"], x["hi"]):
            assert (x["record"], i) not in out
            out[x["record"], i] = (x["source"], x["source_lo"] + i - x["lo"])
    return out


def some(seed, n, records, sources, width):
    g = random.Random(seed)
    return [(g.choice(records), g.randrange(n), lo, lo + g.randrange(1, width), g.choice(sources), g.randrange(200)) for lo in (g.randrange(300) for _ in range(n))]


ODD = [(None, 1, 0, 5, "s", 0), ("A", 3, 5, 5, "s", 0), ("A", 3, 9, 4, "s", 0), ("A", None, 900, 910, "s", 7), ("A", 1, None, 3, "s", 0), ("A", 2, 905, 906, None, 0), ("far", 1, 10**9, 3 * 10**9, "s", 5), ("far", 2, 2 * 10**9, 2 * 10**9 + 1, "t", 0)]


def test_overlay(spark):
    writes = some(1, 150, ["A", "B"], ["X", "Y"], 90) + [w for w in ODD if w[0] != "far"]
    writes += writes[:5]
    got = lineage.overlay(spark.createDataFrame(writes, WRITES)).collect()
    assert spread(got) == plain(writes)
    ends = {(x["record"], x["hi"], x["seq"], x["source"], x["source_lo"] - x["lo"]) for x in got}
    assert not any((x["record"], x["lo"], x["seq"], x["source"], x["source_lo"] - x["lo"]) in ends for x in got)


def test_large_records_have_few_rows(spark):
    got = lineage.overlay(spark.createDataFrame([w for w in ODD if w[0] == "far"], WRITES)).orderBy("lo").collect()
    cut = 2 * 10**9
    assert [(x["lo"], x["hi"], x["source"], x["source_lo"]) for x in got] == [(10**9, cut, "s", 5), (cut, cut + 1, "t", 0), (cut + 1, 3 * 10**9, "s", 5 + 10**9 + 1)]


def test_compose(spark):
    outer, inner = some(2, 40, ["A", "B"], ["X", "Y", "Z"], 50), some(3, 60, ["X", "Y"], ["P", "Q", None], 40)
    o, i = plain(outer), plain(inner)
    got = lineage.compose(lineage.overlay(spark.createDataFrame(outer, WRITES)), lineage.overlay(spark.createDataFrame(inner, WRITES))).collect()
    assert spread(got) == {k: i.get(v, v) for k, v in o.items()}


def test_no_writes(spark):
    none = lineage.overlay(spark.createDataFrame([], WRITES))
    assert none.columns == ["record", "lo", "hi", "seq", "source", "source_lo"] and none.count() == 0 and lineage.compose(none, none).count() == 0


def test_a_small_side_of_overlaps_is_told_to_all(spark):
    """A few records that very many intervals lie in don't gather these: their blocks are known to be few."""
    a = spark.range(1000).selectExpr("'r' AS record", "id % 50 AS lo", "id % 50 + 3 AS hi", "id AS a")
    b = spark.createDataFrame([("r", 0, 10, 1), ("r", 10, 60, 2)], "record string, lo long, hi long, b long").checkpoint()
    got = lineage.overlaps(a, b, lineage.Rounds(spark))
    assert got.selectExpr("sum(hi - lo)").first()[0] == 3000
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString() and "SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_records_of_few_writes_take_one_pass(spark, monkeypatch):
    """Forty records over batches' ends, a struct that is never null as their order: one file for them, and blocks only for the records of very many writes."""
    writes = some(5, 900, [f"R{i}" for i in range(40)], ["X", "Y", None], 90) + some(6, 120, ["hot"], ["X", "Y"], 40)
    df = spark.createDataFrame(writes, WRITES).withColumn("seq", lineage.F.struct("seq", lineage.F.lit("t").alias("t")))
    files, cut = [], lineage.Rounds.cut
    monkeypatch.setattr(lineage.Rounds, "cut", lambda self, x: files.append(1) or cut(self, x))
    monkeypatch.setattr(lineage, "ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        one = lineage.overlay(df).collect()
        assert len(files) == 1
        assert spread(one) == plain(writes)
        monkeypatch.setattr(lineage, "SMALL", 60)
        both = lineage.overlay(df).collect()
        assert len(files) > 4
        monkeypatch.setattr(lineage, "SMALL", 0)
        blocks = lineage.overlay(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(one, key=str) == sorted(both, key=str) == sorted(blocks, key=str)


def test_sources_without_a_place(spark):
    """A null offset is an offset of its own, older than others of its seq and source."""
    rows = [("A", 1, 0, 9, "s", None), ("A", 1, 2, 4, "s", 7), ("A", 1, 9, 12, "s", None)]
    got = lineage.overlay(spark.createDataFrame(rows, WRITES)).orderBy("lo").collect()
    assert [(x["lo"], x["hi"], x["source_lo"]) for x in got] == [(0, 2, None), (2, 4, 7), (4, 12, None)]


def test_two_intervals_share_bytes_once(spark):
    a = spark.createDataFrame([("r", 3, 61, 1), ("r", 61, 64, 2), ("q", 0, 9, 3)], "record string, lo long, hi long, a long")
    b = spark.createDataFrame([("r", 1, 62, 1), ("r", 62, 200, 2), ("r", 5, 6, 3)], "record string, lo long, hi long, b long")
    got = sorted((x["a"], x["b"], x["lo"], x["hi"]) for x in lineage.overlaps(a, b).collect())
    assert got == [(1, 1, 3, 61), (1, 3, 5, 6), (2, 1, 61, 62), (2, 2, 62, 64)]
