"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the digest of its text. A blob is
scanned once per rule version, whatever paths hold it; the ledger, a Parquet table,
keeps the findings, and a join gives them back to all paths.

Defined results: a null text is the empty blob; empty texts have no spans; texts
of any length and with any number of spans are scanned in linear time; null ids are
a path like any other; repeated rows give repeated results from one scan; an empty
table gives empty results; other columns are ignored (scan) or kept (redact_secrets).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardwalk.llm.hot import is_hot, join_facts
from guardwalk.session import checkpoint_dir

RULE_VERSION = "2024-1"


@dataclass(frozen=True)
class Kind:
    """Leftmost non-overlapping matches of `pattern` whose group has `least` characters or more.

    The span begins behind the group `lead`, where there is one.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    lead: int = 0


# Fixed values. [0-9a-f]{16,} is the maximal run of 16 or more, and AKIA[A-Z0-9]{14,} the first AKIA of a
# run that is long enough: the same spans as matching one or more and dropping the short ones. No pattern
# repeats a group (Java recurses once a repetition), and none looks twice at a long run that fails: a jwt
# begins where its run of characters does.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Kind("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Kind("hex", r"[0-9a-f]{16,}", base=True),
    Kind("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Kind("google", r"AIza[0-9A-Za-z_-]{35}"),
    Kind("jwt", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", lead=1),
    Kind("pem", r"-----BEGIN (?:[A-Z][A-Z ]* )?PRIVATE KEY-----"),
)
FINDING = "array<struct<start:bigint,ord:int,end:bigint,kind:string,base:boolean>>"


#: Steps of a running fold that are appended one by one before they become one piece of the next level.
PIECE = 128


def running(items: Column, at: Column, none: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The arrays that `step(at, item) -> (next at, array)` gives along `items`, as one array.

    Folded in pieces of pieces, as an array is copied whenever it grows.
    """

    def level(part: Column, start: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            then, made = step(acc["at"], item)
            return F.struct(then.alias("at"), F.concat(acc["out"], made).alias("out"))

        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), one)

    def piece(acc: Column, part: Column) -> Column:
        done = F.transform(F.array(level(part, acc["at"])), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))
        return done[0]

    def fold(held: Column) -> Column:
        count = F.ceil(F.size(held) / F.lit(PIECE)).cast("int")
        pieces = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(held, i * PIECE + 1, F.lit(PIECE)))).otherwise(F.slice(F.array(held), 1, 0))
        return F.aggregate(pieces, F.struct(at.alias("at"), F.slice(F.array(none), 1, 0).alias("out")), piece, lambda a: F.flatten(a["out"]))

    return F.transform(F.array(items), fold)[0]  # inside the lambda `items` is a value, not evaluated once a piece


def spans_of(text: Column, ord_: int, kind: Kind) -> Column:
    """The kind's spans in code points.

    The pieces between matches and the matches alternate, so the lengths of both
    give every match its place.
    """
    none = F.from_json(F.lit("[]"), FINDING)
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(group)), F.length)
    whole, gaps = lengths(0), F.transform(F.split(text, kind.pattern, -1), F.length)
    # the piece behind the last match has no match of its own
    columns = [gaps.alias("gap"), whole.alias("len"), (lengths(kind.group) if kind.group else whole).alias("held")] + ([lengths(kind.lead).alias("lead")] if kind.lead else [])
    parts = F.filter(F.arrays_zip(*columns), lambda p: p["len"].isNotNull())

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + p["gap"]
        end = start + p["len"]
        shown = start + p["lead"] if kind.lead else start
        one = F.struct(shown.alias("start"), F.lit(ord_).alias("ord"), end.alias("end"), F.lit(kind.name).alias("kind"), F.lit(kind.base).alias("base"))
        return end, F.when(p["held"] >= kind.least, F.array(one)).otherwise(none)

    return F.when(F.rlike(text, F.lit(kind.pattern)), running(parts, F.lit(0).cast("bigint"), none, step)).otherwise(none)


def findings_of(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """All spans of a text by start, then kind as listed."""
    return F.array_sort(F.flatten(F.array(*[spans_of(text, i, k) for i, k in enumerate(kinds)])))


def address(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob_id, _text): one row per version of a path."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("path"), F.sha2(text, 256).alias("blob_id"), text.alias("_text"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Ledger rows (blob_id, rule_version, findings) for blob and rule-version pairs not in `ledger`.

    One holder of each blob is chosen from digests alone, so texts move once, dealt
    by blob and holder; copies of a hot blob don't meet. The patterns run behind that
    join (the text they read is null without a holder), so only chosen texts are read.
    """
    holders = versions.groupBy("blob_id").agg(F.min("path").alias("holder"))
    h = holders.select(F.col("blob_id").alias("_id"), "holder")
    if ledger is None:
        h = h.hint("shuffle_hash")  # texts are streamed past it unsorted
    else:  # few blobs are new, so that Spark may broadcast them once it has seen their size
        h = h.join(ledger.filter(F.col("rule_version") == rule_version).select(F.col("blob_id").alias("_id")), "_id", "left_anti")
    texts = versions.join(h, (F.col("blob_id") == F.col("_id")) & F.col("path").eqNullSafe(F.col("holder")))
    found = texts.select("blob_id", findings_of(F.when(F.col("_id").isNotNull(), F.col("_text")).otherwise(""), kinds).alias("findings"))
    return found.groupBy("blob_id").agg(F.first("findings").alias("findings")).select("blob_id", F.lit(rule_version).alias("rule_version"), "findings")


def findings_by_path(versions: DataFrame, rows: DataFrame, total: int, rule_version: str = RULE_VERSION) -> DataFrame:
    """Every version of every path with its blob's findings (empty where the blob has none)."""
    none = F.from_json(F.lit("[]"), FINDING)
    hits = rows.filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select(F.col("blob_id").alias("_id"), "findings")
    counts = versions.groupBy("blob_id").agg(F.count("*").alias("n_paths"))
    facts = counts.join(hits, F.col("blob_id") == F.col("_id"), "left").filter(F.col("findings").isNotNull() | is_hot("n_paths", total)).drop("_id")
    j = join_facts(versions.select("path", "blob_id"), "blob_id", [F.col("path")], facts, "n_paths", total, small=few("findings"))
    return j.select("path", "blob_id", F.coalesce("findings", none).alias("findings"))


def read_ledger(spark: SparkSession, path: str, rule_version: str | None = None) -> DataFrame | None:
    """The stored ledger (of one rule version), or None where nothing is stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.schema(f"blob_id string, findings {FINDING}, rule_version string, prefix string").parquet(path)
    return (rows.filter(F.col("rule_version") == rule_version) if rule_version else rows).select("blob_id", "rule_version", "findings")


def append_ledger(new: DataFrame, path: str) -> None:
    """Ledger rows as Parquet, in folders by rule version and first digit of the blob's address."""
    dealt = new.withColumn("prefix", F.substring("blob_id", 1, 1)).repartition("prefix", F.pmod(F.xxhash64("blob_id"), F.lit(256)))
    dealt.write.mode("append").partitionBy("rule_version", "prefix").parquet(path)


def scan(docs: DataFrame, path: str, rule_version: str = RULE_VERSION, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings by path; what the ledger under `path` doesn't know is scanned and appended to it."""
    versions = address(docs, id_col, text_col)
    append_ledger(scan_unseen(versions, read_ledger(docs.sparkSession, path, rule_version), rule_version, kinds), path)
    return findings_by_path(versions, read_ledger(docs.sparkSession, path, rule_version), docs.count(), rule_version)


def few(findings: str) -> Column:
    """Whether a blob's findings may be broadcast."""
    return F.coalesce(F.size(findings) <= 1000, F.lit(True))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(listed(F.filter("findings", lambda f: f["base"])), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"),
    )


def redacted(text: Column, findings: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by a mark; overlapping spans give one mark."""

    def cut(chars: Column) -> Column:
        between = lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), (b - a).cast("int")), "")
        end = F.array(F.struct(F.size(chars).cast("bigint").alias("start"), F.lit(True).alias("last"), F.size(chars).cast("bigint").alias("end")))
        spans = F.concat(F.transform(findings, lambda f: F.struct(f["start"].alias("start"), F.lit(False).alias("last"), f["end"].alias("end"))), end)

        def step(at: Column, f: Column) -> tuple[Column, Column]:
            made = F.when(f["last"], F.array(between(at, F.greatest(at, f["start"])))).when(f["start"] >= at, F.array(between(at, f["start"]), F.lit(mark)))
            return F.greatest(at, f["end"]), F.coalesce(made, F.array().cast("array<string>"))

        return F.array_join(running(spans, F.lit(0).cast("bigint"), F.array().cast("array<string>"), step), "")

    return F.when(F.size(findings) == 0, text).otherwise(F.transform(F.array(F.split(text, "")), cut)[0])


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents and columns, secrets in their texts replaced; texts without any stay as they are."""
    path = f"{checkpoint_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    append_ledger(scan_unseen(address(docs, id_col, text_col)), path)
    hits = read_ledger(docs.sparkSession, path).filter(F.size("findings") > 0).select(F.col("blob_id").alias("_id"), F.col("findings").alias("_found"))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_path"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("_blob"))
    counts = row.groupBy("_blob").agg(F.count("*").alias("_n"))
    total = docs.count()
    facts = counts.join(hits, F.col("_blob") == F.col("_id"), "left").filter(F.col("_found").isNotNull() | is_hot("_n", total)).drop("_id")
    j = join_facts(row, "_blob", [F.col("_path")], facts, "_n", total, small=few("_found"))
    clean = F.when(F.col("_found").isNull(), F.col("_row")[text_col]).otherwise(redacted(F.col("_row")[text_col], F.col("_found")))
    return j.select(*[clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """A first scan: the ledger, new in the shared folder, knows no blob yet."""
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"))


def oracle(kinds: tuple[Kind, ...] = KINDS) -> str:
    parts = []
    for i, k in enumerate(kinds):
        p = k.pattern.replace("'", "''")
        parts.append(f"""
SELECT u, doc_id, {i} AS ord, '{k.name}' AS kind, {str(k.base).lower()} AS base, s + lead AS st, s + l AS en FROM (
  SELECT u, doc_id, j, l, held, lead, (sum(g) OVER w + coalesce(sum(l) OVER (PARTITION BY u ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM (
    SELECT u, doc_id, j, length(b[j]) AS g, length(m[j]) AS l, length(h[j]) AS held, {"length(f[j])" if k.lead else "0"} AS lead FROM (
      SELECT u, doc_id, b, m, h, f, unnest(range(1, len(m) + 1)) AS j FROM (
        SELECT u, doc_id, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {k.group}) AS h, regexp_extract_all(t, '{p}', {k.lead}) AS f FROM d)))
  WINDOW w AS (PARTITION BY u ORDER BY j)) WHERE held >= {k.least}""")
    one = "kind || ':' || st || ':' || en"
    return f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg({one}, ',' ORDER BY st, ord, en) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' ORDER BY st, ord, en), '') AS spans
FROM d LEFT JOIN f USING (u) GROUP BY u, d.doc_id
"""


ORACLE = oracle()
