"""WARC archives and a reader that salvages damaged ones.

Writing: one gzip member per record; of records with equal payloads the one with
the largest id is the response and the others are revisits, which keep the HTTP
headers but no payload. Reading: each member or record must pass its checks
(gzip CRC and length, version line, content length, block and payload digest).
After a failure the reader looks for the next valid member or version line, goes
on there, and logs the bytes between as a gap.

`store_archives` writes archives as objects of a folder, `read_archives` reads any
folder of archives that Spark can reach. The query reads back what it has written
itself, so a gap there is an error and stops it.

Defined results: a null html is an empty payload; null ids are responses of
their own; repeated rows (equal id and payload) are all responses or all
revisits; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardwalk.llm.hot import join_facts
from guardwalk.session import checkpoint_dir

ARCHIVE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "archive string, kind string, offset long, length long, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, uri string, reason string, payload binary"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: str | None, uri: str | None, payload: bytes, refers_to: str | None, size: int, digest: str) -> bytes:
    """One uncompressed WARC record; a revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = quote(page_id or "", safe="")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(uri or f'urn:page:{name}', safe=':/?#[]@!$&()*+,;=%~-._')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{sha1_32(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def mark_revisits(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, uri, body, holder): `holder` is the id of the response for revisits. Bodies of hot revisits don't move."""
    rows = pages.select(
        pages[id_col].alias("page_id"), pages[uri_col].cast("string").alias("uri"), F.coalesce(pages[body_col], F.lit("")).cast("binary").alias("body")
    ).withColumn("digest", F.sha2("body", 256)).withColumn("n_bytes", F.octet_length("body"))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1")
    later = F.col("page_id").isNotNull() & (F.col("page_id") != F.col("_h_holder"))
    sized = rows.withColumn("sha1", F.sha1("body"))
    j = join_facts(sized, "digest", [F.col("page_id"), F.col("uri")], groups, "n", pages.count(), {"body": F.when(later, F.lit(None)).otherwise(F.col("body"))})
    revisit = F.col("page_id").isNotNull() & F.col("holder").isNotNull() & (F.col("page_id") != F.col("holder"))
    return j.select(
        F.col("page_id").cast("string"), "uri", F.when(~revisit | revisit.isNull(), F.col("body")).alias("body"),
        F.when(revisit, F.col("holder").cast("string")).alias("refers_to"), F.col("n_bytes").cast("long").alias("n_bytes"), "sha1",
    )


def write_archives(marked: DataFrame, archive_bytes: int = ARCHIVE_BYTES, compress: bool = True) -> DataFrame:
    """(archive, bytes): whole archives of about `archive_bytes`, a task's records in turn."""
    schema = pa.schema([("archive", pa.string()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{k:04d}.warc" + ".gz" * compress]), pa.array([b"".join(parts)], pa.binary())], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, 64):
                for page_id, uri, body, refers_to, n, sha1 in zip(*[c.to_pylist() for c in b.slice(at, 64).columns], strict=True):
                    one = record(page_id, uri, body or b"", refers_to, n, base64.b32encode(bytes.fromhex(sha1)).decode())
                    parts.append(member(one) if compress else one)
                    size += len(parts[-1])
                    if size >= archive_bytes:
                        yield full()
                        parts, size, k = [], 0, k + 1
        if parts:
            yield full()

    return marked.select("page_id", "uri", "body", "refers_to", "n_bytes", "sha1").mapInArrow(run, "archive string, bytes binary")


class Damaged(Exception):
    pass


class Scan:
    """Where marks come next along a buffer. A stretch without a mark is searched once, so that damage costs no second search.

    `looked` counts the bytes that were searched, unpacked or hashed.
    """

    def __init__(self, data: bytes):
        self.data, self.looked = data, 0
        self.free: dict[bytes, tuple[int, int]] = {}  # mark -> (from, to): the next mark from anywhere in there is at `to`

    def next(self, mark: bytes, at: int) -> int:
        """The first place of `mark` from `at` on; the buffer's length if there is none."""
        begin, x = self.free.get(mark, (0, -1))
        if not begin <= at <= x:
            x = self.data.find(mark, at)
            x = len(self.data) if x < 0 else x
            self.looked += x - at
            self.free[mark] = at, x
        return x


#: Bytes of a record's header, and of a member's name or comment; what is longer counts as damage.
MOST_HEADER = 1 << 16


def body_of(scan: Scan, at: int) -> int:
    """Where the deflated bytes of the gzip member at `at` begin (RFC 1952)."""
    data = scan.data
    if at + 10 > len(data):
        raise Damaged("member cut short")
    flags, p = data[at + 3], at + 10
    if flags & 0xE0:
        raise Damaged("gzip flags")
    if flags & 4:
        p += 2 + int.from_bytes(data[p : p + 2], "little")
    for part in (8, 16):
        if flags & part:
            end = scan.next(b"\0", p) if p < len(data) else len(data)
            if end - p > MOST_HEADER or end == len(data):
                raise Damaged("gzip header")
            p = end + 1
    if flags & 2:
        scan.looked += p - at
        if int.from_bytes(data[p : p + 2], "little") != zlib.crc32(data[at:p]) & 0xFFFF:
            raise Damaged("gzip header")
        p += 2
    return p


def unpack(scan: Scan, at: int) -> tuple[bytes, int]:
    """The gzip member at `at` and where it ends; its CRC and length have been checked. Few bytes are tried first, as most false marks fail there."""
    data, pos, step = scan.data, body_of(scan, at), 256
    z, out = zlib.decompressobj(-15), []
    try:
        while not z.eof:
            if pos >= len(data):
                raise Damaged("member cut short")
            out.append(z.decompress(data[pos : pos + step]))
            scan.looked += min(step, len(data) - pos)
            pos, step = pos + min(step, len(data) - pos), min(2 * step, MOST_HEADER)
    except zlib.error as e:
        raise Damaged("gzip data") from e
    whole, end = b"".join(out), pos - len(z.unused_data)
    if end + 8 > len(data):
        raise Damaged("member cut short")
    if data[end : end + 8] != (zlib.crc32(whole)).to_bytes(4, "little") + (len(whole) & 0xFFFFFFFF).to_bytes(4, "little"):
        raise Damaged("gzip check")
    return whole, end + 8


FIRST = re.compile(re.escape(VERSION) + rb"\d+\r\n")
HEADER = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")


def parse(scan: Scan, at: int = 0) -> tuple[dict, int]:
    """The record at `at` and where it ends; its digests have been checked. A header ends before the next version line."""
    data = scan.data
    if not (first := FIRST.match(data, at)):
        raise Damaged("version line")
    stop = scan.next(b"\r\n\r\n", at)
    if stop == len(data):
        raise Damaged("header cut short")
    if stop - at > MOST_HEADER or scan.next(b"\n" + VERSION, first.end() - 1) < stop:
        raise Damaged("header")
    scan.looked += stop - at
    head = {m[1].strip().lower(): m[2].strip() for m in HEADER.finditer(data, first.end(), stop + 2)}
    size = head.get(b"content-length", b"")
    if not size.isdigit():
        raise Damaged("content length")
    begin, end = stop + 4, stop + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    block = data[begin:end]
    scan.looked += 2 * len(block)
    said = lambda k: head.get(k, b"").decode("latin-1")
    if (want := said(b"warc-block-digest")) and want != f"sha1:{sha1_32(block)}":
        raise Damaged("block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    kind, digest = said(b"warc-type"), said(b"warc-payload-digest").removeprefix("sha1:")
    sizes = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
    n = int(sizes[1]) if sizes else len(payload)
    if kind == "response" and (n != len(payload) or digest and digest != sha1_32(payload)):
        raise Damaged("payload digest")
    if kind == "response" and not digest:
        digest = sha1_32(payload)
    return {"kind": kind, "id": said(b"warc-record-id"), "refers": said(b"warc-refers-to"), "uri": said(b"warc-target-uri"), "digest": digest, "n": n, "payload": payload}, end + 4


def salvage_bytes(archive: str, data: bytes, with_payload: bool = False, scan: Scan | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA: every record that passes its checks, and the gaps between them.

    The only record of a member has the member's place. Of several records in one,
    the rows' offset is the member's and the first row has all its length, the others
    none; the reason of a gap inside it says where in the unpacked bytes it is.
    """
    from urllib.parse import unquote

    name = lambda u: unquote(m[1]) if (m := re.fullmatch(r"<urn:page:(.*)>", u)) and m[1] else None

    def gap(at: int, size: int, why: str) -> tuple:
        return (archive, "gap", at, size, None, None, None, None, None, None, why, None)

    def found(at: int, size: int, r: dict) -> tuple:
        return (archive, "record", at, size, name(r["id"]), r["n"], r["digest"], r["kind"], name(r["refers"]), r["uri"], None, r["payload"] if with_payload else None)

    scan = scan or Scan(data)
    at, bad, why = 0, -1, ""
    while at < len(data):
        inside: list[tuple[int, int, dict | str]] = []
        try:
            if data.startswith(MAGIC, at):
                whole, end = unpack(scan, at)
                inside = list(records_in(whole, scan))
                if not any(isinstance(r, dict) for _, _, r in inside):
                    raise Damaged(next((r for _, _, r in inside), "version line"))
            else:
                r, end = parse(scan, at)
                inside = [(0, end - at, r)]
        except Damaged as e:
            if bad < 0:
                bad, why = at, str(e)
            at = min(scan.next(MAGIC, at + 1), scan.next(VERSION, at + 1))
            continue
        if bad >= 0:
            yield gap(bad, at - bad, why)
            bad = -1
        size = end - at
        for a, b, r in inside:
            yield found(at, size, r) if isinstance(r, dict) else gap(at, size, f"{r}, unpacked bytes {a} to {b}")
            size = 0
        at = end
    if bad >= 0:
        yield gap(bad, len(data) - bad, why)


def records_in(whole: bytes, outer: Scan) -> Iterator[tuple[int, int, dict | str]]:
    """(from, to, record or what is wrong) along a member's unpacked bytes."""
    at, bad, why, scan = 0, -1, "", Scan(whole)
    while at < len(whole):
        try:
            r, end = parse(scan, at)
        except Damaged as e:
            if bad < 0:
                bad, why = at, str(e)
            at = scan.next(VERSION, at + 1)
            continue
        if bad >= 0:
            yield bad, at, why
            bad = -1
        yield at, end, r
        at = end
    if bad >= 0:
        yield bad, len(whole), why
    outer.looked += scan.looked


def salvage(archives: DataFrame, with_payload: bool = False, rows: int = 500) -> DataFrame:
    """All recovered records and all quarantined gaps of (archive, bytes)."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields = archives.sparkSession.createDataFrame([], SCHEMA).schema.fields
    out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def pack(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                made: list[tuple] = []
                for row in salvage_bytes(b.column(0)[i].as_py(), b.column(1)[i].as_py() or b"", with_payload):
                    made.append(row)
                    if len(made) >= rows:
                        yield pack(made)
                        made = []
                if made:
                    yield pack(made)

    return archives.select("archive", "bytes").mapInArrow(run, SCHEMA)


def store_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, path, n_bytes) of the objects written to `folder`, which every executor must have mounted.

    `archives` must be read from a stored table or checkpoint, so that a task that runs
    again writes the same bytes; an object gets its name only when it is whole.
    """
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                path, part = os.path.join(folder, name), os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([len(data)], pa.int64())], schema=schema)

    return archives.select("archive", "bytes").mapInArrow(run, "archive string, path string, n_bytes long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, bytes) of every .warc and .warc.gz object below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("bytes"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    checkpoint_dir(spark)
    archives = write_archives(mark_revisits(pages)).checkpoint()  # the stored archives, in the shared folder
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in an archive of this query:"), "archive", "offset", "reason")).cast("boolean")
    r = salvage(archives).filter(F.when(F.col("kind") == "record", True).otherwise(lost))
    kind = dict(pages.dtypes)["page_id"]
    return r.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_V = "('0x' || substr(h, 5 * {i} + 1, 5))::BIGINT"
_CHARS = " || ".join(f"substr('{_ALPHABET}', ((({_V.format(i=i)} // {32**j}) % 32) + 1)::INT, 1)" for i in range(8) for j in (3, 2, 1, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h, CASE WHEN page_id <> holder THEN holder END AS refers_to FROM p)
SELECT page_id, payload_bytes, {_CHARS} AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM d
"""
