"""Records of varying length: round trips in any number of partitions, foreign files, damage."""

import random

import pytest

from guardwalk.sources import records
from guardwalk.sources.records import Varying

LAYOUT = Varying(head=6, counter=4, entry=3, tail=1)


def made(n, seed=1, most=40):
    r = random.Random(seed)
    return [i.to_bytes(4, "big") + (k := r.choice([0, 1, r.randrange(most)])).to_bytes(2, "big") + r.randbytes(3 * k) + b"." for i in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(bytearray(x),) for x in rows], "record binary").repartition(parts)


def test_any_number_of_partitions_reads_every_record_once(spark, tmp_path):
    rows, path = made(3000), str(tmp_path / "r")
    records.write_varying(frame(spark, rows), path, LAYOUT, stride=500)
    for parts in (1, 2, 7, 50, 0):
        df = records.read_varying(spark, path, LAYOUT, parts)
        assert not parts or df.rdd.getNumPartitions() == parts
        got = df.collect()
        assert sorted(bytes(r["record"]) for r in got) == sorted(rows) and len({(r["file"], r["offset"]) for r in got}) == len(rows)
    more = made(100, 2)
    records.write_varying(frame(spark, more, 1), path, LAYOUT)
    assert records.read_varying(spark, path, LAYOUT, 4).count() == 3100
    records.write_varying(frame(spark, more, 2), path, LAYOUT, mode="overwrite")
    assert sorted(bytes(r["record"]) for r in records.read_varying(spark, path, LAYOUT, 4).collect()) == sorted(more)


def test_occurrences(spark, tmp_path):
    rows, path = made(200), f"file:{tmp_path}/o"
    records.write_varying(frame(spark, rows), path, LAYOUT)
    got = records.read_varying(spark, path, LAYOUT, 3)
    got = got.select("record", LAYOUT.occurrences(got.record).alias("e")).collect()
    assert all([bytes(x) for x in r["e"]] == [bytes(r["record"][i : i + 3]) for i in range(6, len(r["record"]) - 1, 3)] for r in got)


def test_foreign_files_and_damage(spark, tmp_path, monkeypatch):
    rows = made(500, 3)
    (tmp_path / "f").mkdir()
    for i in range(3):
        (tmp_path / "f" / f"{i}.dat").write_bytes(b"".join(rows[i::3]))
    (tmp_path / "f" / "empty.dat").write_bytes(b"")
    assert records.index_files(spark, str(tmp_path / "f"), LAYOUT, 200) == 500
    assert sorted(bytes(r["record"]) for r in records.read_varying(spark, str(tmp_path / "f"), LAYOUT, 9).collect()) == sorted(rows)
    (tmp_path / "f" / "0.dat").write_bytes(b"".join(rows[::3])[:-2])
    with pytest.raises(Exception, match="cut short"):
        records.read_varying(spark, str(tmp_path / "f"), LAYOUT, 2).collect()
    with pytest.raises(Exception, match="cut short"):
        records.index_files(spark, str(tmp_path / "f"), LAYOUT)
    with pytest.raises(Exception, match="counter says"):
        records.write_varying(frame(spark, [rows[0] + b"x"]), str(tmp_path / "bad"), LAYOUT)


def test_blocks_smaller_than_records(tmp_path, monkeypatch):
    monkeypatch.setattr(records, "BLOCK", 7)
    rows = made(100, 4)
    (tmp_path / "a").write_bytes(b"".join(rows))
    store, at = records.opened(str(tmp_path / "a"))
    got = list(records.records_of(store, at, LAYOUT, 0, sum(map(len, rows))))
    assert [x for _, x in got] == rows and [o for o, _ in got] == [sum(map(len, rows[:i])) for i in range(100)]


def test_nothing(spark, tmp_path):
    records.write_varying(frame(spark, []), str(tmp_path / "n"), LAYOUT)
    assert records.read_varying(spark, str(tmp_path / "n"), LAYOUT, 3).count() == 0
