"""Quality rules: a threshold table compiled into one Spark projection.

Every ratio is a built-in expression over the whole text; no user function runs.

Defined results: a null or empty text has no words, no lines, zero counts and
fails the `min_words` rule; texts of any length are measured whole; repeated
rows give repeated results; an empty table gives an empty table; other columns
of the input are ignored (score) or kept as they are (keep_quality).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
# Function words of the four languages, matched in any case of a-z,
# with trailing commas or full stops.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "au aux ce dans de des du en est et il la le les ne pas par plus pour que qui sur un une "
    "auf aus das dem den der die ein eine für im ist mit nicht sich sie und von zu "
    "al como con del el es las lo los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if `numerator` is below `low` or above `high` times `denominator`."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    base: bool = False


# The threshold table. Ratios are compared as products, so no division by zero.
THRESHOLDS = (
    Rule("min_words", "n_words", "one", low=20, base=True),
    Rule("repeat_words", "n_repeat_words", "n_words", high=0.30, base=True),
    Rule("word_length", "word_chars", "n_words", low=2, high=15),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", "n_words", low=0.05),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=0.80),
)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside `body`."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: Column) -> Column:
    """Words that stand in a window of 8 words found twice or more in the array.

    Hashes only decide whether a document can have a repeat at all; what is
    counted are equal windows of words.
    """
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    windows = F.array_sort(
        F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("k"), i.alias("i")))
    )

    def covered(s: Column) -> Column:
        twin = lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"])
        hit = F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"]))
        return F.aggregate(
            hit,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
            lambda a: a["n"],
        )

    may_repeat = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n <= WINDOW, F.lit(0)).when(may_repeat, let(windows, covered)).otherwise(F.lit(0)).cast("long")


def measure(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """`keep` and the counts of the table's ratios, one row per input row."""
    stop = "(?i)(?<![^\\x20\\x09-\\x0D])(?:" + "|".join(sorted(set(STOP_WORDS), key=len, reverse=True)) + ")[.,]*(?![^\\x20\\x09-\\x0D])"
    a = df.select(*keep, F.coalesce(text, F.lit("")).alias("_t"))
    names = a.columns[:-1]
    b = a.select(
        *names,
        "_t",
        F.array_remove(F.split("_t", SPACE), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("_l"),
    )
    c = b.select(*names, "_t", "_w", "_l", F.size("_w").alias("_n"))
    return c.select(
        *names,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w"), F.col("_n")).alias("n_repeat_words"),
        F.regexp_count("_t", F.lit(stop)).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column, Column]:
    """(base failed, any failed, comma-joined names of failed rules) over measured columns."""
    named, base, every = [], F.lit(False), F.lit(False)
    for r in rules:
        top, under = F.col(r.numerator), F.lit(1) if r.denominator == "one" else F.col(r.denominator)
        bad = F.lit(False)
        # Bounds are held in hundredths, so that the comparison is exact in whole numbers.
        if r.low is not None:
            bad = bad | (100 * top < round(100 * r.low) * under)
        if r.high is not None:
            bad = bad | (100 * top > round(100 * r.high) * under)
        named.append(F.when(bad, F.lit(r.name)))
        base, every = (base | bad if r.base else base), every | bad
    return base, every, F.concat_ws(",", *named)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Counts, verdicts and the names of the failed rules per document."""
    base, every, names = compile_rules(rules)
    m = measure(docs, docs[text_col], [docs[id_col].alias("doc_id")])
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~every).alias("kept"), "n_stop_words", "n_lines", names.alias("failed_rules"),
    )


def keep_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The documents that pass every rule, with all their columns."""
    _, every, _ = compile_rules(rules)
    m = measure(docs, docs[text_col], [F.struct(*[docs[c] for c in docs.columns]).alias("_row")])
    # A filter would be pushed below the projection and its expressions put in place of the columns, so that the
    # words would be split again for every use; below a numbered projection it isn't.
    return m.withColumn("_at", F.monotonically_increasing_id()).filter(~every & (F.col("_at") >= 0)).select("_row.*")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t,
        list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM a)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM h WHERE c > 1),
r AS (SELECT doc_id, sum(least(8, i - coalesce(p, i - 8))) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w)::BIGINT AS n_words,
        length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: translate(rtrim(x, '.,'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words,
        len(l)::BIGINT AS n_lines
      FROM a LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2,
        100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words AS f3,
        100 * n_symbols > 25 * n_words AS f4, 100 * n_stop_words < 5 * n_words AS f5,
        100 * n_dup_lines > 80 * n_lines AS f6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  f1 OR f2 AS base_failed, NOT (f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept, n_stop_words, n_lines,
  concat_ws(',', CASE WHEN f1 THEN 'min_words' END, CASE WHEN f2 THEN 'repeat_words' END, CASE WHEN f3 THEN 'word_length' END,
    CASE WHEN f4 THEN 'symbols' END, CASE WHEN f5 THEN 'stop_words' END, CASE WHEN f6 THEN 'dup_lines' END) AS failed_rules
FROM f
"""


def query(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
