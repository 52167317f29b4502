"""Records of varying length: a table in each that occurs as often as a counter says.

Where a record begins is known only from the counters of all before it, so a file can't be cut
at any byte. The writer adds up lengths as it goes and keeps the offset of a record every
STRIDE bytes; the reader plans its partitions from that index, so any number of them reads any
number of files, each record once. Files of another origin are indexed by a job first.

Files are reached through Arrow's file systems (local and mounted folders, s3, gs, hdfs). Tasks
write files of their own and only those of successful attempts come into the index, so
that a task that runs again, or twice at once, adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

STRIDE, BLOCK, ROWS = 1 << 20, 1 << 20, 4096
INDEX = "_index.json"
SCHEMA = "file string, offset long, record binary"


@dataclass(frozen=True)
class Varying:
    """Bytes of a record: a head that holds the counter (binary, big-endian), `entry` bytes for each occurrence, a tail."""

    head: int
    counter: int
    entry: int
    counter_bytes: int = 2
    tail: int = 0

    def size(self, data, at: int = 0) -> int:
        """Length of the record whose head stands at `at`."""
        c = at + self.counter
        return self.head + int.from_bytes(data[c : c + self.counter_bytes], "big") * self.entry + self.tail

    def options(self) -> dict[str, str]:
        return {k: str(v) for k, v in asdict(self).items()}

    @staticmethod
    def of(options) -> Varying:
        return Varying(**{k: int(options[k]) for k in ("head", "counter", "entry", "counter_bytes", "tail") if options.get(k) is not None})

    def occurrences(self, record: Column) -> Column:
        """The table's entries as an array of bytes, of as many as the record's length holds."""
        n = F.floor((F.length(record) - self.head - self.tail) / self.entry).cast("int")
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(record, i * self.entry + self.head + 1, F.lit(self.entry)))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_index(path: str) -> list[dict]:
    store, at = opened(path)
    with store.open_input_stream(f"{at}/{INDEX}") as f:
        return json.loads(f.read())["files"]


def write_index(path: str, files: list[dict]) -> None:
    store, at = opened(path)
    with store.open_output_stream(f"{at}/{INDEX}.new") as f:
        f.write(json.dumps({"files": files}).encode())
    store.move(f"{at}/{INDEX}.new", f"{at}/{INDEX}")


def records_of(store: fs.FileSystem, path: str, layout: Varying, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) between two offsets at which records begin; a block and one record are held at once."""
    with store.open_input_file(path) as f:
        at, held, base = begin, b"", begin
        while at < end:
            need = layout.head
            while True:
                if len(held) - (at - base) < need:
                    held = held[at - base :] + f.read_at(max(BLOCK, need), base + len(held))
                    base = at
                if len(held) - (at - base) < need:
                    raise ValueError(f"{path}: the record at {at} is cut short")
                if need > layout.head or (whole := layout.size(held, at - base)) == need:
                    break
                need = whole
                if need == layout.head:
                    break
            yield at, held[at - base : at - base + need]
            at += need
        if at != end:
            raise ValueError(f"{path}: the record before {at} goes beyond {end}")


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)


class VaryingReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.layout, self.parts = options["path"], Varying.of(options), int(options.get("partitions") or 0)

    def partitions(self) -> list[InputPartition]:
        """Stretches between indexed offsets, as many partitions as asked for (one a stretch at most), alike in bytes."""
        cuts = []
        for f in read_index(self.path):
            ends = [*f["offsets"][1:], f["size"]]
            cuts += [(f["name"], a, b) for a, b in zip(f["offsets"], ends, strict=True) if b > a]
        total = sum(b - a for _, a, b in cuts)
        n = max(1, min(self.parts or len(cuts), len(cuts)))
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(n)]
        done = 0
        for c in cuts:
            out[min(n - 1, done * n // max(1, total))].append(c)
            done += c[2] - c[1]
        return [_Ranges(x) for x in out if x] or [_Ranges([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, folder = opened(self.path)
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record", pa.binary())])
        for name, begin, end in partition.value:
            at, rows, size = [], [], 0
            for offset, record in records_of(store, f"{folder}/{name}", self.layout, begin, end):
                at.append(offset)
                rows.append(record)
                size += len(record)
                if size >= BLOCK or len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(at, pa.int64()), pa.array(rows, pa.binary())], schema=schema)
                    at, rows, size = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(at, pa.int64()), pa.array(rows, pa.binary())], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    file: dict | None


class VaryingWriter(DataSourceArrowWriter):
    def __init__(self, options, column: str, overwrite: bool):
        self.path, self.layout, self.stride = options["path"], Varying.of(options), int(options.get("stride") or STRIDE)
        self.column, self.overwrite = column, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        name, size, n, offsets = f"part-{uuid.uuid4().hex}.rec", 0, 0, []
        with store.open_output_stream(f"{folder}/{name}") as out:
            for b in iterator:
                for record in b.column(b.schema.get_field_index(self.column)):
                    data = record.as_py()
                    if data is None or len(data) < self.layout.head or len(data) != self.layout.size(data):
                        raise ValueError(f"a record of {len(data or b'')} bytes isn't as long as its counter says")
                    if not offsets or size - offsets[-1] >= self.stride:
                        offsets.append(size)
                    out.write(data)
                    size, n = size + len(data), n + 1
        if not n:
            store.delete_file(f"{folder}/{name}")
        return _Written({"name": name, "size": size, "records": n, "offsets": offsets} if n else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        before = read_index(self.path) if store.get_file_info(f"{folder}/{INDEX}").type == fs.FileType.File else []
        write_index(self.path, ([] if self.overwrite else before) + sorted((m.file for m in messages if m and m.file), key=lambda f: f["name"]))
        for f in before if self.overwrite else []:
            store.delete_file(f"{folder}/{f['name']}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{folder}/{m.file['name']}")


class VaryingSource(DataSource):
    """Format `varying`: options path, those of `Varying`, partitions (read) and stride (write); written frames have one column, of bytes."""

    @classmethod
    def name(cls) -> str:
        return "varying"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VaryingReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return VaryingWriter(self.options, schema.fields[0].name, overwrite)


def write_varying(records: DataFrame, path: str, layout: Varying, mode: str = "append", stride: int = STRIDE) -> None:
    """One column of bytes, a record a row."""
    records.sparkSession.dataSource.register(VaryingSource)
    records.write.format("varying").options(**layout.options(), stride=str(stride)).mode(mode).save(path)


def read_varying(spark: SparkSession, path: str, layout: Varying, partitions: int = 0) -> DataFrame:
    """(file, offset, record) in any number of partitions; none asked for: one a stride."""
    spark.dataSource.register(VaryingSource)
    return spark.read.format("varying").options(**layout.options(), partitions=str(partitions)).load(path)


def index_files(spark: SparkSession, path: str, layout: Varying, stride: int = STRIDE) -> int:
    """Index the files of another origin in a folder, a task a file; the records found."""
    store, folder = opened(path)
    names = [(i.base_name,) for i in store.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = opened(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                size, n, offsets = own.get_file_info(f"{at}/{name}").size, 0, []
                for offset, _ in records_of(own, f"{at}/{name}", layout, 0, size):
                    if not offsets or offset - offsets[-1] >= stride:
                        offsets.append(offset)
                    n += 1
                yield pa.RecordBatch.from_pydict({"name": [name], "size": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64()), "offsets": pa.array([offsets], pa.list_(pa.int64()))})

    found = spark.createDataFrame(names, "name string").repartition(max(1, len(names))).mapInArrow(run, "name string, size long, records long, offsets array<long>").collect() if names else []
    write_index(path, sorted((r.asDict() for r in found if r["records"]), key=lambda f: f["name"]))
    return sum(r["records"] for r in found)
