"""Queries that parse and run programs: the driver's rows are the entry states."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardwalk.functions.conditions import contradicts, dnf, normalised, parse, rendered, substituted
from guardwalk.operators import coverage, graph
from guardwalk.plans.relational import _EVENTS, sql_values
from guardwalk.plans.runner import final_states, run_program, verdicts
from guardwalk.plans.solver import literals, plans
from guardwalk.plans.values import related
from guardwalk.plans.worlds import worlds
from guardwalk.sources import program as source

SOURCE = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. PRICER.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  WS-FLAG   PIC X.
           88 RETURNED VALUE 'A' 'R'.
       01  WS-QTY    PIC 9(3).
       01  WS-STATUS PIC X.
       01  WS-N      PIC 9(3).
       PROCEDURE DIVISION.
       A-MAIN.
      * the flagship's five decisions
           IF RETURNED
              CONTINUE
           END-IF
           PERFORM B-BAND
           PERFORM C-STATUS
           PERFORM VARYING WS-N FROM 1 BY 1 UNTIL WS-N > 2
              CONTINUE
           END-PERFORM
           GOBACK
           .
       B-BAND.
           EVALUATE WS-QTY
              WHEN 1 THRU 10
                 CONTINUE
              WHEN > 40
                 CONTINUE
              WHEN OTHER
                 CONTINUE
           END-EVALUATE
           .
       C-STATUS.
           IF WS-STATUS = 'O '
              GO TO D-OPEN
           END-IF
           .
       D-OPEN.
           EXIT
           .
"""
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def states(read) -> DataFrame:
    x = read("lineitem")
    return x.select((x.l_orderkey * 10 + x.l_linenumber).alias("run_id"), x.l_returnflag.alias("WS_FLAG"), x.l_quantity.cast("int").alias("WS_QTY"), x.l_linestatus.alias("WS_STATUS"))


def _src(spark) -> DataFrame:
    return spark.createDataFrame([(SOURCE,)], "source string")


@query(f"""WITH {_EVENTS}, k AS (SELECT * FROM (VALUES (1, 'A-MAIN', 0), (2, 'B-BAND', 1), (3, 'B-BAND', 3), (4, 'B-BAND', 5), (5, 'C-STATUS', 0)) t(ordinal, paragraph, pos))
 SELECT paragraph, k.pos AS ordinal, kind, result AS direction, count(DISTINCT run_id) AS n_runs FROM e JOIN k USING (ordinal) GROUP BY 1, 2, 3, 4
 UNION ALL SELECT 'A-MAIN', 4, 'LOOP', TRUE, count(DISTINCT l_orderkey * 10 + l_linenumber) FROM lineitem WHERE l_linestatus <> 'O'""")
def program_runs(spark, read) -> DataFrame:
    """Direction coverage of the program over all lineitems, by running it; a jump out of C-STATUS skips the loop."""
    e = run_program(SOURCE, states(read)).filter("ordinal IS NOT NULL")
    return coverage.observe(e, key=("paragraph", "ordinal", "kind")).drop("first_run")


@query("SELECT CASE WHEN l_linestatus = 'O' THEN 'verified' ELSE 'wrong_direction' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1")
def program_verdicts(spark, read) -> DataFrame:
    """Every lineitem is a run of its own; equal states share their verdict."""
    per_state = states(read).groupBy("WS_FLAG", "WS_QTY", "WS_STATUS").agg(F.count("*").alias("runs"))
    named = per_state.withColumn("run_id", F.concat_ws("|", "WS_FLAG", "WS_QTY", "WS_STATUS"))
    v = verdicts(run_program(SOURCE, named.drop("runs")), "C-STATUS", 0, True)
    return v.join(named.select("run_id", "runs"), "run_id").groupBy("verdict").agg(F.sum("runs").alias("n"))


@query("SELECT * FROM (VALUES ('A-MAIN', 'B-BAND', 1::BIGINT, 'perform'), ('A-MAIN', 'C-STATUS', 2, 'perform'), ('B-BAND', 'C-STATUS', 3, 'fallthrough'), ('C-STATUS', 'D-OPEN', 4, 'goto'), ('C-STATUS', 'D-OPEN', 5, 'fallthrough')) t(caller, callee, seq, kind)")
def program_edges(spark, read) -> DataFrame:
    return source.edges(_src(spark)).select("caller", "callee", "seq", "kind")


@query("SELECT * FROM (VALUES ('A-MAIN', 0), ('B-BAND', 1), ('C-STATUS', 1), ('D-OPEN', 2)) t(paragraph, depth)")
def program_depths(spark, read) -> DataFrame:
    return graph.depths(source.edges(_src(spark)), "A-MAIN")


@query("SELECT * FROM (VALUES ('WS-FLAG', 'X', NULL), ('WS-QTY', '9(3)', NULL), ('WS-STATUS', 'X', NULL), ('WS-N', '9(3)', NULL)) t(field, pic, value)")
def program_fields(spark, read) -> DataFrame:
    return source.fields(_src(spark)).select("field", "pic", "value")


@query("SELECT * FROM (VALUES ('A-MAIN', 0, 'IF'), ('A-MAIN', 4, 'LOOP'), ('B-BAND', 1, 'WHEN'), ('B-BAND', 3, 'WHEN'), ('B-BAND', 5, 'WHEN'), ('C-STATUS', 0, 'IF')) t(paragraph, ordinal, kind)")
def program_branches(spark, read) -> DataFrame:
    return source.branches(_src(spark)).select("paragraph", "ordinal", "kind")


@query("SELECT * FROM (VALUES ('A-MAIN', 0::INTEGER, 7), ('B-BAND', 1, 4), ('C-STATUS', 2, 2), ('D-OPEN', 3, 1)) t(paragraph, pos, n_statements)")
def program_paragraphs(spark, read) -> DataFrame:
    return source.paragraphs(_src(spark)).select("paragraph", "pos", "n_statements")


@query("""SELECT * FROM (VALUES ('A-MAIN', ['A-MAIN'], '{}', 'verified'), ('B-BAND', ['A-MAIN', 'B-BAND'], '{}', 'verified'),
 ('C-STATUS', ['A-MAIN', 'C-STATUS'], '{}', 'verified'), ('D-OPEN', ['A-MAIN', 'C-STATUS', 'D-OPEN'], '{"WS-STATUS": "O "}', 'verified')) t(target, chain, state, verdict)""")
def program_plans(spark, read) -> DataFrame:
    """An entry state for every paragraph, checked by running it."""
    return plans(_src(spark)).select("target", "chain", "state", "verdict")


HEAD = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. VERBS.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
"""
ARITHMETIC = HEAD + """
       01  WS-QTY    PIC 9(3).
       01  WS-LINE   PIC 9.
       01  WS-DISC   PIC 9(2).
       01  WS-SUM    PIC S9(4).
       01  WS-PROD   PIC 9(3).
       01  WS-QUOT   PIC 9(3).
       01  WS-REST   PIC 9(3).
       01  WS-HALF   PIC 9(3).
       01  WS-WIDE   PIC X VALUE 'N'.
       PROCEDURE DIVISION.
       A-MAIN.
           SUBTRACT WS-QTY FROM WS-LINE GIVING WS-SUM
           MULTIPLY WS-QTY BY 30 GIVING WS-PROD
              ON SIZE ERROR MOVE 'Y' TO WS-WIDE
           END-MULTIPLY
           DIVIDE WS-QTY BY WS-LINE GIVING WS-QUOT REMAINDER WS-REST
           COMPUTE WS-HALF ROUNDED = (WS-QTY + WS-DISC) / 2 + 1 / 0
           GOBACK.
"""


def _last(name: str, kind: str = "bigint"):
    return F.get_json_object("state", f"$.{name}").cast(kind)


@query("""SELECT q AS qty, l AS line, d AS disc, l - q AS diff, CASE WHEN q * 30 > 999 THEN 0 ELSE q * 30 END AS prod, q // l AS quot, q % l AS rest,
 (q + d + 1) // 2 AS half, CASE WHEN q * 30 > 999 THEN 'Y' ELSE 'N' END AS wide, count(*) AS n
 FROM (SELECT l_quantity::BIGINT AS q, l_linenumber::BIGINT AS l, round(l_discount * 100)::BIGINT AS d FROM lineitem) GROUP BY q, l, d""")
def verb_arithmetic(spark, read) -> DataFrame:
    """SUBTRACT GIVING, MULTIPLY with a size error, DIVIDE with its remainder and a rounded COMPUTE, run on every state."""
    x = read("lineitem").select(F.col("l_quantity").cast("long").alias("qty"), F.col("l_linenumber").cast("long").alias("line"), F.round(F.col("l_discount") * 100).cast("long").alias("disc"))
    seen = x.groupBy("qty", "line", "disc").agg(F.count("*").alias("n")).withColumn("run_id", F.concat_ws("|", "qty", "line", "disc"))
    runs = final_states(ARITHMETIC, seen.select("run_id", F.col("qty").alias("WS_QTY"), F.col("line").alias("WS_LINE"), F.col("disc").alias("WS_DISC")))
    out = runs.select("run_id", _last("WS_SUM").alias("diff"), _last("WS_PROD").alias("prod"), _last("WS_QUOT").alias("quot"), _last("WS_REST").alias("rest"), _last("WS_HALF").alias("half"), _last("WS_WIDE", "string").alias("wide"))
    return seen.join(out, "run_id").drop("run_id")


TEXTS = HEAD + """
       01  WS-PRIO   PIC X(15).
       01  WS-NO     PIC X(2).
       01  WS-NAME   PIC X(15).
       01  WS-COUNT  PIC 9(2).
       01  WS-ES     PIC 9(2).
       01  WS-OUT    PIC X(20).
       01  WS-AT     PIC 9(2) VALUE 1.
       PROCEDURE DIVISION.
       A-MAIN.
           UNSTRING WS-PRIO DELIMITED BY '-' INTO WS-NO
              WS-NAME COUNT IN WS-COUNT
           END-UNSTRING
           INSPECT WS-NAME TALLYING WS-ES FOR ALL 'E'
           INSPECT WS-NAME CONVERTING 'AEIOU' TO '12345'
           STRING WS-NAME DELIMITED BY SPACE '/' WS-NO DELIMITED BY SIZE
              INTO WS-OUT WITH POINTER WS-AT
           END-STRING
           GOBACK.
"""


@query("""SELECT o_orderpriority AS prio, length(o_orderpriority) - 2 + (15 - length(o_orderpriority)) AS width, length(o_orderpriority) - length(replace(o_orderpriority, 'E', '')) AS es,
 split_part(translate(substr(o_orderpriority, 3), 'AEIOU', '12345'), ' ', 1) || '/' || substr(o_orderpriority, 1, 1) || ' ' AS joined, count(*) AS n FROM orders GROUP BY o_orderpriority""")
def verb_texts(spark, read) -> DataFrame:
    """UNSTRING, INSPECT TALLYING and CONVERTING, and STRING with a pointer, on every priority."""
    seen = read("orders").groupBy(F.col("o_orderpriority").alias("prio")).agg(F.count("*").alias("n"))
    runs = final_states(TEXTS, seen.select(F.col("prio").alias("run_id"), F.col("prio").alias("WS_PRIO")))
    joined = F.substring(_last("WS_OUT", "string"), F.lit(1), _last("WS_AT", "int") - 1)
    out = runs.select(F.col("run_id").alias("prio"), _last("WS_COUNT").alias("width"), _last("WS_ES").alias("es"), joined.alias("joined"))
    return seen.join(out, "prio")


LOOKUP = HEAD + """
       01  WS-KEYS   PIC X(3) VALUE 'FOP'.
       01  WS-TABLE REDEFINES WS-KEYS.
           05 WS-KEY PIC X OCCURS 3 TIMES INDEXED BY IX.
       01  WS-LIST.
           05 WS-ITEM PIC X OCCURS 3 TIMES INDEXED BY IY.
       01  WS-STATUS PIC X.
       01  WS-FOUND  PIC 9.
       PROCEDURE DIVISION.
       A-MAIN.
           MOVE 'FOP' TO WS-LIST
           SET IY TO 1
           SEARCH WS-ITEM
              AT END MOVE 9 TO WS-FOUND
              WHEN WS-ITEM(IY) = WS-STATUS
                 SET WS-FOUND TO IY
           END-SEARCH
           GOBACK.
"""


@query("SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 9 END AS found, count(*) AS n FROM orders GROUP BY o_orderstatus")
def verb_search(spark, read) -> DataFrame:
    """SEARCH through a table of a program, for every order's status."""
    seen = read("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    runs = final_states(LOOKUP, seen.select(F.col("status").alias("run_id"), F.col("status").alias("WS_STATUS")))
    return seen.join(runs.select(F.col("run_id").alias("status"), _last("WS_FOUND", "int").alias("found")), "status")


NESTED = HEAD + """
       01  WS-N      PIC 9(3).
       01  WS-I      PIC 9(3).
       01  WS-J      PIC 9(3).
       01  WS-COUNT  PIC 9(4).
       PROCEDURE DIVISION.
       A-MAIN.
           PERFORM VARYING WS-I FROM 1 BY 1 UNTIL WS-I > WS-N
              AFTER WS-J FROM 1 BY 1 UNTIL WS-J > WS-I
              IF WS-J = 3
                 EXIT PERFORM CYCLE
              END-IF
              ADD 1 TO WS-COUNT
           END-PERFORM
           GOBACK.
"""


@query("SELECT l_linenumber::BIGINT AS lines, (l_linenumber * (l_linenumber + 1) // 2 - greatest(l_linenumber - 2, 0))::BIGINT AS steps, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def verb_nested_loops(spark, read) -> DataFrame:
    """PERFORM VARYING with AFTER and EXIT PERFORM CYCLE."""
    seen = read("lineitem").groupBy(F.col("l_linenumber").cast("long").alias("lines")).agg(F.count("*").alias("n"))
    runs = final_states(NESTED, seen.select(F.col("lines").alias("run_id"), F.col("lines").alias("WS_N")))
    return seen.join(runs.select(F.col("run_id").alias("lines"), _last("WS_COUNT").alias("steps")), "lines")


READER = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. READER.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT IN-FILE ASSIGN TO INDD
               FILE STATUS IS WS-FS.
       DATA DIVISION.
       FILE SECTION.
       FD  IN-FILE.
       01  IN-REC.
           05 IN-KEY  PIC X(2).
           05 IN-AMT  PIC S9(5)V99 COMP-3.
           05 IN-TAB  OCCURS 3 TIMES.
              10 IN-CODE PIC 9(4) COMP.
           05 IN-ALT REDEFINES IN-TAB PIC X(6).
       WORKING-STORAGE SECTION.
       01  WS-FS     PIC X(2).
       01  WS-N      PIC 9(3).
       01  WS-BAD    PIC 9(3).
       01  WS-DONE   PIC X VALUE 'N'.
       PROCEDURE DIVISION.
       A-MAIN.
           OPEN INPUT IN-FILE
           IF WS-FS = '35'
              GOBACK
           END-IF
           PERFORM B-READ UNTIL WS-DONE = 'Y'
           GOBACK.
       B-READ.
           READ IN-FILE
              AT END MOVE 'Y' TO WS-DONE
              NOT AT END ADD 1 TO WS-N
           END-READ
           IF WS-FS = '23'
              ADD 1 TO WS-BAD
           END-IF.
"""


def _reader(spark) -> DataFrame:
    return spark.createDataFrame([(READER,)], "source string")


@query("SELECT * FROM (VALUES ('io', 3::BIGINT), ('sequence', 3), ('fault', 9)) t(kind, n)")
def program_worlds(spark, read) -> DataFrame:
    """The worlds of a program's own operations: bare, empty and populated, sequences, faults by code and call."""
    return worlds(_reader(spark)).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (VALUES ('bare', 200::BIGINT, 0::BIGINT, 'loop_limit'), ('empty', 0, 0, 'ended'), ('populated', 1, 0, 'ended'), ('sequence 1', 1, 0, 'ended'), ('sequence 2', 2, 0, 'ended'), ('sequence 3', 3, 0, 'ended'),
 ('READ:IN-FILE 23 at 1', 2, 1, 'ended'), ('READ:IN-FILE 23 at 2', 2, 1, 'ended'), ('READ:IN-FILE 46 at 1', 0, 0, 'ended'), ('READ:IN-FILE 46 at 2', 1, 0, 'ended'), ('READ:IN-FILE 35 at 1', 2, 0, 'ended'), ('READ:IN-FILE 35 at 2', 2, 0, 'ended'),
 ('OPEN:IN-FILE 35 at 1', 0, 0, 'ended'), ('OPEN:IN-FILE 23 at 1', 3, 0, 'ended'), ('OPEN:IN-FILE 30 at 1', 3, 0, 'ended')) t(world, records, bad, stopped)""")
def world_runs(spark, read) -> DataFrame:
    """What the program does in each of its worlds."""
    runs = final_states(READER, worlds(_reader(spark)).select(F.col("world").alias("run_id"), "outcomes"))
    return runs.select(F.col("run_id").alias("world"), _last("WS_N").alias("records"), _last("WS_BAD").alias("bad"), "stopped")


@query("""SELECT * FROM (VALUES ('A-MAIN', 1, 'IF', TRUE, 1::BIGINT), ('A-MAIN', 1, 'IF', FALSE, 14), ('A-MAIN', 3, 'LOOP', TRUE, 14), ('B-READ', 0, 'AT END', TRUE, 13), ('B-READ', 0, 'AT END', FALSE, 12),
 ('B-READ', 3, 'IF', TRUE, 2), ('B-READ', 3, 'IF', FALSE, 14)) t(paragraph, ordinal, kind, direction, n_runs)""")
def phrase_directions(spark, read) -> DataFrame:
    """Directions of decisions and conditional phrases over all worlds of the program."""
    e = run_program(READER, worlds(_reader(spark)).select(F.col("world").alias("run_id"), "outcomes")).filter("ordinal IS NOT NULL")
    return coverage.observe(e, key=("paragraph", "ordinal", "kind")).drop("first_run")


@query("""SELECT * FROM (VALUES ('IN-REC', 0::INTEGER, 12::INTEGER, 0::INTEGER), ('IN-KEY', 0, 2, 0), ('IN-AMT', 2, 4, 0), ('IN-TAB', 6, 6, 3), ('IN-CODE', 6, 2, 0), ('IN-ALT', 6, 6, 0)) t(field, "offset", length, occurs)""")
def program_layout(spark, read) -> DataFrame:
    """The bytes of a file's record, from its declaration."""
    return source.layouts(_reader(spark)).filter("record = 'IN-REC'").select("field", "offset", "length", "occurs")


@query("SELECT 'IN-FILE' AS file, 'INDD' AS assign, 'SEQUENTIAL' AS organization, 'WS-FS' AS status, 'IN-REC' AS record")
def program_files(spark, read) -> DataFrame:
    return source.files(_reader(spark)).drop("program")


@query("SELECT * FROM (VALUES ('A-MAIN', 0, 'OPEN:IN-FILE', 0), ('B-READ', 0, 'READ:IN-FILE', 2)) t(paragraph, ordinal, operation, phrases)")
def program_operations(spark, read) -> DataFrame:
    return source.operations(_reader(spark)).select("paragraph", "ordinal", "operation", F.size("phrases").alias("phrases"))


@query("SELECT * FROM (VALUES ('WS-A', 'X'), ('WS-TOTAL', '9(2)'), ('WS-DEEP', '9')) t(field, pic)")
def copy_expansion(spark, read) -> DataFrame:
    """COPY with REPLACING, and a book in a book, found and expanded by joins."""
    text = HEAD + "       COPY PART-1 REPLACING ==:P:== BY ==WS== OLD-TOTAL BY WS-TOTAL.\n       PROCEDURE DIVISION.\n       A-MAIN.\n           GOBACK.\n"
    books = spark.createDataFrame([("PART-1", "       01 :P:-A PIC X.\n       01 OLD-TOTAL PIC 9(2).\n       COPY PART-2.\n"), ("PART-2", "       01 WS-DEEP PIC 9.\n")], "book string, text string")
    src = source.expanded(spark.createDataFrame([("main", text)], "path string, source string"), books)
    return source.fields(src).select("field", "pic")


def _mapped(df: DataFrame, f: Callable[..., object], kind: str) -> DataFrame:
    """A column `said` = f(the row's columns), a batch at a time."""
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + f", said {kind}"

    def run(frames):
        for pdf in frames:
            yield pdf.assign(said=pd.Series([f(*r) for r in pdf.itertuples(index=False)], dtype=object))

    return df.mapInPandas(run, schema)


_PAIRS = [
    ("A = 1", "A = 2", True), ("A = 1", "A NOT = 2", False), ("A > 5", "A < 5", True), ("A > 5", "A < 7", False), ("A >= 5", "A <= 5", False), ("A > 5", "A = 5", True),
    ("A = 'X'", "A = 'X  '", False), ("A = 'X'", "A = 'Y'", True), ("A IS NUMERIC", "A IS NOT NUMERIC", True), ("A = 1", "B = 2", False), ("5 > A", "A > 6", True),
]
_TEXTS = [
    ("a is greater than 5", "A > 5"), ("A > 5", "A > 5"), ("NOT ( A = 1 OR 2 )", "NOT ( A = 1 OR A = 2 )"), ("A EQUAL TO 'x'  AND b NOT LESS 3", "A = 'x' AND B >= 3"),
    ("A IS NOT NUMERIC", "A IS NOT NUMERIC"), ("A NOT = SPACES", "A NOT = ' '"),
]


@query(f"WITH {sql_values('w', 'a, b, want', [(a, b, int(x)) for a, b, x in _PAIRS])} SELECT a, b, want = 1 AS said FROM w")
def contradictions(spark, read) -> DataFrame:
    """Pairs of conditions that nothing satisfies together."""
    one = lambda text: dnf(parse(text))[0][0]
    return _mapped(spark.createDataFrame([p[:2] for p in _PAIRS], "a string, b string"), lambda a, b: contradicts(one(a), one(b), related), "boolean")


@query(f"WITH {sql_values('w', 'text, said', _TEXTS)} SELECT * FROM w")
def text_normalisation(spark, read) -> DataFrame:
    """Conditions of different spelling in one."""
    return _mapped(spark.createDataFrame([t[:1] for t in _TEXTS], "text string"), normalised, "string")


@query("SELECT o_orderstatus AS status, '''' || o_orderstatus || ''' = ''O'' AND B > 2' AS said, count(*) AS n FROM orders GROUP BY 1, 2")
def constant_substitution(spark, read) -> DataFrame:
    """A condition with a field's value put in, for every status."""
    seen = read("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return _mapped(seen, lambda status, n: rendered(substituted(parse("ST = 'O' AND B > 2"), {"ST": status})), "string").select("status", "said", "n")


@query("""SELECT * FROM (VALUES ('WS-FLAG', ['"A"', '"R"']), ('WS-QTY', ['1', '10', '40']), ('WS-STATUS', ['"O "'])) t(field, literals)""")
def literal_harvest(spark, read) -> DataFrame:
    """The values that a program's conditions compare its fields with."""

    def run(frames):
        for pdf in frames:
            rows = [(f, [json.dumps(v) for v in vs]) for t in pdf["source"] for f, vs in literals(source.parse_program(t)).items()]
            yield pd.DataFrame(rows, columns=["field", "literals"])

    return _src(spark).mapInPandas(run, "field string, literals array<string>")


@query("""SELECT 'A-MAIN' AS paragraph, count(*) AS n_runs FROM lineitem UNION ALL SELECT 'B-BAND', count(*) FROM lineitem UNION ALL SELECT 'C-STATUS', count(*) FROM lineitem
 UNION ALL SELECT 'D-OPEN', count(*) FILTER (l_linestatus = 'O') FROM lineitem""")
def paragraph_coverage(spark, read) -> DataFrame:
    """How many runs enter each paragraph: every different state runs once and counts as often as it occurs."""
    seen = states(read).groupBy("WS_FLAG", "WS_QTY", "WS_STATUS").agg(F.count("*").alias("runs")).withColumn("run_id", F.concat_ws("|", "WS_FLAG", "WS_QTY", "WS_STATUS"))
    ends = final_states(SOURCE, seen.drop("runs")).join(seen.select("run_id", "runs"), "run_id")
    entered = ends.select("runs", F.explode(F.split("entered", ",")).alias("paragraph")).groupBy("paragraph").agg(F.sum("runs").alias("n_runs"))
    return source.paragraphs(_src(spark)).select("paragraph").join(entered, "paragraph", "left").select("paragraph", F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"))
