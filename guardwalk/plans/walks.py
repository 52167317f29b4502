"""Queries on ways through programs and on evidence, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardwalk.operators import evidence, flow, graph, paths
from guardwalk.plans.programs import HEAD, READER, SOURCE, _src, states
from guardwalk.plans.relational import sql_values, values
from guardwalk.plans.runner import final_states, run_program
from guardwalk.plans.solver import plans
from guardwalk.plans.worlds import worlds
from guardwalk.sources import program as source
from guardwalk.sources import stores

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        ORACLES[f.__name__] = sql
        return f

    return put


ENDER = HEAD + """
       01  WS-X      PIC 9.
       01  WS-Y      PIC X.
       PROCEDURE DIVISION.
       A-MAIN.
           PERFORM B-CHECK
           IF WS-X = 1
              GOBACK
           END-IF
           IF WS-X = 2
              PERFORM C-WORK
           ELSE
              PERFORM D-REST
           END-IF
           GOBACK.
       B-CHECK.
           IF WS-Y = 'Z'
              STOP RUN
           END-IF.
       C-WORK.
           CONTINUE.
       D-REST.
           CONTINUE.
       E-LATE.
           GOBACK.
           PERFORM D-REST.
"""


def _ender(spark) -> DataFrame:
    return source.statements(spark.createDataFrame([(ENDER,)], "source string"))


def listed(rows: list[tuple], columns: str, types: str = "*") -> str:
    return f"WITH {sql_values('w', columns, rows)} SELECT {types} FROM w"


# ---- ways


@query(listed([(1, "D-OPEN", 2, 1), (2, "B-BAND", 1, 0), (3, "C-STATUS", 1, 0), (4, "A-MAIN", 0, 0)], "rank, paragraph, depth, n_guards", "rank, paragraph, depth, n_guards::BIGINT AS n_guards"))
def ranked_frames(spark, read) -> DataFrame:
    """A program's frames, the most guarded first."""
    return paths.frames(graph.shortest_chains(source.edges(_src(spark)), "A-MAIN"))


@query(listed([("A-MAIN", 0, "A-MAIN"), ("B-BAND", 0, "A-MAIN"), ("B-BAND", 1, "B-BAND"), ("C-STATUS", 0, "A-MAIN"), ("C-STATUS", 1, "C-STATUS"), ("D-OPEN", 0, "A-MAIN"), ("D-OPEN", 1, "C-STATUS"), ("D-OPEN", 2, "D-OPEN")], "target, pos, frame"))
def chain_positions(spark, read) -> DataFrame:
    return paths.positions(graph.shortest_chains(source.edges(_src(spark)), "A-MAIN"))


@query("""SELECT CASE WHEN l_linestatus = 'O' THEN 3 ELSE 2 END AS entered, CASE WHEN l_linestatus <> 'O' THEN 2 END AS pos,
 CASE WHEN l_linestatus <> 'O' THEN 'D-OPEN' END AS missing, count(*) AS n_runs FROM lineitem GROUP BY l_linestatus = 'O', 1, 2, 3""")
def first_missing_frame(spark, read) -> DataFrame:
    """How far every run comes along the chain to D-OPEN; equal states run once and count as often as they occur."""
    seen = states(read).groupBy("WS_FLAG", "WS_QTY", "WS_STATUS").agg(F.count("*").alias("runs")).withColumn("run_id", F.concat_ws("|", "WS_FLAG", "WS_QTY", "WS_STATUS"))
    ends = final_states(SOURCE, seen.drop("runs")).join(seen.select("run_id", "runs"), "run_id")
    chain = graph.shortest_chains(source.edges(_src(spark)), "A-MAIN").filter("paragraph = 'D-OPEN'").select("chain")
    n, pos, frame = paths.on_chain(F.split("entered", ","), F.col("chain"))
    told = ends.join(F.broadcast(chain), F.lit(True)).select("runs", n.alias("entered"), pos.alias("pos"), frame.alias("missing"))  # one row of chain
    return told.groupBy("entered", "pos", "missing").agg(F.sum("runs").alias("n_runs"))


@query("SELECT 3 AS depth, 'A-MAIN>B-BAND>C-STATUS>D-OPEN' AS chain")
def chain_via(spark, read) -> DataFrame:
    """The shortest chain that passes B-BAND on its way to D-OPEN."""
    return paths.chain_via(source.edges(_src(spark)), ["A-MAIN", "B-BAND", "D-OPEN"]).select("depth", F.array_join("chain", ">").alias("chain"))


@query(listed([("A-MAIN", 0), ("B-CHECK", 1), ("C-WORK", 2), ("D-REST", 3), ("E-LATE", 4)], "paragraph, rank"))
def execution_order(spark, read) -> DataFrame:
    return source.execution_order(spark.createDataFrame([(ENDER,)], "source string")).select("paragraph", "rank")


@query(listed([("A-MAIN", 0, "B-CHECK", "", False), ("A-MAIN", 4, "C-WORK", "NOT ( WS-X = 1 )|NOT ( WS-Y = 'Z' )", False), ("A-MAIN", 5, "D-REST", "NOT ( WS-X = 1 )|NOT ( WS-Y = 'Z' )", False), ("E-LATE", 1, "D-REST", "", True)],
    "paragraph, ordinal, callee, obligations, infeasible"))
def survival(spark, read) -> DataFrame:
    """What must hold so that the run is still going at each call."""
    return paths.survival(_ender(spark)).select("paragraph", "ordinal", "callee", F.array_join("obligations", "|").alias("obligations"), "infeasible")


@query(listed([("A-MAIN", 1, True, "WS-X = 1"), ("A-MAIN", 1, False, "NOT ( WS-X = 1 )"), ("A-MAIN", 3, True, "WS-X = 2"), ("A-MAIN", 3, False, "NOT ( WS-X = 2 )"), ("B-CHECK", 0, True, "WS-Y = 'Z'"), ("B-CHECK", 0, False, "NOT ( WS-Y = 'Z' )")],
    "paragraph, ordinal, direction, obligations"))
def branch_obligations(spark, read) -> DataFrame:
    return paths.branch_obligations(_ender(spark)).select("paragraph", "ordinal", "direction", F.array_join("obligations", " AND ").alias("obligations"))


@query(listed([("A-MAIN", 2, 1), ("B-READ", 1, 2)], "paragraph, n_ops, rank", "paragraph, n_ops::BIGINT AS n_ops, rank"))
def resume_points(spark, read) -> DataFrame:
    src = spark.createDataFrame([(READER,)], "source string")
    ops = source.operations(src).select("paragraph", F.col("operation").alias("op"))
    return paths.resume_points(flow.reach(source.edges(src), ops))


# ---- evidence


@query("""SELECT DISTINCT o_orderstatus AS op, CASE o_orderstatus WHEN 'F' THEN '>' WHEN 'O' THEN '<=' ELSE '=' END AS flipped,
 max(o_custkey) + CASE o_orderstatus WHEN 'F' THEN -1 ELSE 0 END AS companion FROM orders GROUP BY o_orderstatus""")
def companions(spark, read) -> DataFrame:
    """The other side of a relation whose one side is pinned, and the relation from there."""
    op = F.when(F.col("o_orderstatus") == "F", "<").when(F.col("o_orderstatus") == "O", ">=").otherwise("=")
    top = read("orders").groupBy("o_orderstatus").agg(F.max("o_custkey").alias("pin"))
    return top.select(F.col("o_orderstatus").alias("op"), evidence.flipped(op).alias("flipped"), evidence.companion(op, F.col("pin")).alias("companion"))


@query("""SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END, p_partkey) AS rank FROM part""")
def detection_rank(spark, read) -> DataFrame:
    """Candidates of a slot by the rank of their category, then as they stand."""
    p = read("part").select("p_partkey", "p_brand", F.split("p_type", " ")[0].alias("category"), F.col("p_partkey").alias("pos"))
    return evidence.ranked(p, "p_brand", "category", ["PROMO", "SMALL"]).select("p_partkey", "p_brand", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_brand, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name) AS k FROM part) WHERE k = 1")
def best_evidence(spark, read) -> DataFrame:
    """The longest text seen for a slot."""
    return evidence.best_evidence(read("part"), "p_brand", "p_name")


@query("""WITH u AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders), d AS (SELECT k.o_custkey, t.value, t.pos FROM (SELECT DISTINCT o_custkey FROM orders) k, (VALUES ('F', 1), ('O', 2), ('P', 3), ('X', 4)) t(value, pos))
 SELECT d.o_custkey::VARCHAR AS field, arg_min(d.value, d.pos) AS value FROM d LEFT JOIN u ON u.o_custkey = d.o_custkey AND u.o_orderstatus = d.value WHERE u.o_custkey IS NULL GROUP BY 1""")
def complement_values(spark, read) -> DataFrame:
    """A value of the domain that a field is compared with nowhere."""
    o = read("orders").select(F.col("o_custkey").cast("string").alias("field"), F.col("o_orderstatus").alias("value")).distinct()
    domain = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(i).alias("pos")) for i, v in enumerate("FOPX")])
    return evidence.complement(o.select("field").distinct().select("field", F.inline(domain)), o)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN repeat('1', length(o_orderpriority)) WHEN o_orderkey % 3 = 1 THEN repeat('A', length(o_orderpriority)) ELSE repeat('X', length(o_orderpriority)) END AS value FROM orders")
def conforming_values(spark, read) -> DataFrame:
    """A text of a picture's class and width."""
    kind = F.element_at(F.array(*map(F.lit, ("numeric", "alphabetic", "alphanumeric"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return read("orders").select("o_orderkey", evidence.conforming(kind, F.length("o_orderpriority")).alias("value"))


_MODELS = [("REC", None, None, 1, 0), ("A", "X", "REC", 1, 1), ("B", "9", "REC", 1, 2), ("B", "9(4)", "REC", 2, 0), ("C", "X(2)", "REC", 2, 1), ("REC", None, None, 2, 2)]


@query(listed([("REC", None, None, "A,B,C"), ("A", "X", "REC", ""), ("B", "9(4)", "REC", ""), ("C", "X(2)", "REC", "")], "field, pic, parent, children"))
def model_merge(spark, read) -> DataFrame:
    """Data models of several sources in one."""
    m = values(spark, _MODELS, "field string, pic string, parent string, src_order int, pos int")
    return evidence.merged_models(m).withColumn("children", F.array_join("children", ","))


@query("""WITH f AS (SELECT p_partkey, unnest(list_distinct(string_split(upper(p_name), ' '))) AS token FROM part), g(record, token) AS (VALUES ('RED-SMALL', 'RED'), ('RED-SMALL', 'SMALL'), ('BLUE-RING', 'BLUE'), ('BLUE-RING', 'RING')),
 n AS (SELECT p_partkey, record, count(*) AS score FROM f JOIN g USING (token) WHERE token <> '' GROUP BY 1, 2 HAVING count(*) >= 1)
 SELECT p_partkey::VARCHAR || '-' || (SELECT replace(upper(p_name), ' ', '-') FROM part q WHERE q.p_partkey = n.p_partkey) AS field, arg_min(record, (-score, record)) AS record, max(score) AS score FROM n GROUP BY p_partkey""")
def record_groups(spark, read) -> DataFrame:
    """The record that an undeclared field's name points to, by shared tokens."""
    f = read("part").select(F.concat_ws("-", F.col("p_partkey").cast("string"), F.replace(F.upper("p_name"), F.lit(" "), F.lit("-"))).alias("field"))
    return evidence.record_group(f, values(spark, [("RED-SMALL",), ("BLUE-RING",)], "record string"), 1)


_WANTS = [("two good records", "WS_N", "2"), ("two good records", "WS_BAD", "0"), ("a bad one", "WS_BAD", "1"), ("nine", "WS_N", "9")]


@query(listed([("a bad one", "READ:IN-FILE 23 at 1"), ("two good records", "READ:IN-FILE 35 at 1")], "guard, run_id"))
def witness_handover(spark, read) -> DataFrame:
    """Runs whose last state has what a consumer's guard wants."""
    runs = final_states(READER, worlds(spark.createDataFrame([(READER,)], "source string")).select(F.col("world").alias("run_id"), "outcomes"))
    return evidence.handover(runs, values(spark, _WANTS, "guard string, field string, value string"))


@query(listed([("READ:IN-FILE", 0, "23,00"), ("READ:IN-FILE", 1, "00,23,00"), ("READ:IN-FILE", 2, "00,00,23,00"), ("OPEN:IN-FILE", 0, "35,00"), ("OPEN:IN-FILE", 1, "00,35,00"), ("OPEN:IN-FILE", 2, "00,00,35,00")], "op, successes, outcomes"))
def delivery_schedules(spark, read) -> DataFrame:
    """Successes, one failure, then success again, for every operation that can fail."""
    ops = source.operations(spark.createDataFrame([(READER,)], "source string")).select("operation").distinct()
    code = F.when(F.col("operation").startswith("OPEN"), "35").otherwise("23")
    each = ops.select(F.col("operation").alias("op"), F.posexplode(evidence.schedules(F.col("operation"), code, 2)).alias("successes", "s"))
    return each.select("op", "successes", F.array_join("s", ",").alias("outcomes"))


@query("""WITH p AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS pool FROM orders)
 SELECT o_orderkey, pool[('0x' || substr(md5('s:' || o_orderkey || ':PRIO'), 1, 8))::BIGINT % len(pool) + 1] AS value FROM orders, p""")
def pool_sampling(spark, read) -> DataFrame:
    """A value of a literal pool for every row, by digest: the same in any partitioning."""
    o = read("orders")
    pool = o.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("pool"))  # the distinct literals of one field
    return o.join(F.broadcast(pool), F.lit(True)).select("o_orderkey", evidence.sampled("s", F.col("o_orderkey"), F.lit("PRIO"), F.col("pool")).alias("value"))


@query("""SELECT '[["NAT","' || c_nationkey || '"],["SEG","' || c_mktsegment || '"]]' AS state, count(*) AS n FROM customer GROUP BY 1""")
def canonical_states(spark, read) -> DataFrame:
    """States in one spelling, whatever order their fields came in."""
    a, b = (F.lit("SEG"), F.col("c_mktsegment")), (F.lit("NAT"), F.col("c_nationkey").cast("string"))
    state = F.when(F.col("c_custkey") % 2 == 0, F.create_map(*a, *b)).otherwise(F.create_map(*b, *a))
    return read("customer").groupBy(evidence.canonical_state(state).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS slot, count(DISTINCT o_orderstatus) >= 2 AS injectable, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1")
def proxy_profile(spark, read) -> DataFrame:
    """What evidence shows a harness can set."""
    return evidence.proxy_profile(read("orders").select(F.col("o_custkey").alias("slot"), F.col("o_orderstatus").alias("value")))


# ---- a program's worlds, plans and operations against a harness


def _worlds(spark) -> DataFrame:
    return worlds(spark.createDataFrame([(READER,)], "source string"))


@query("SELECT * FROM (VALUES ('io', 'loop_limit', 1::BIGINT), ('io', 'ended', 2), ('sequence', 'ended', 3), ('fault', 'ended', 9)) t(kind, disposition, n)")
def world_dispositions(spark, read) -> DataFrame:
    """How the runs in each kind of world end."""
    w = _worlds(spark)
    ends = final_states(READER, w.select(F.col("world").alias("run_id"), "outcomes"))
    return ends.join(w.select(F.col("world").alias("run_id"), "kind"), "run_id").groupBy("kind", F.col("stopped").alias("disposition")).agg(F.count("*").alias("n"))


@query(listed([("A-MAIN", 1, "IF", True, "OPEN:IN-FILE 35 at 1"), ("A-MAIN", 1, "IF", False, "empty"), ("B-READ", 0, "AT END", True, "empty"), ("B-READ", 0, "AT END", False, "populated"), ("B-READ", 3, "IF", True, "READ:IN-FILE 23 at 1"), ("B-READ", 3, "IF", False, "empty")],
    "paragraph, ordinal, kind, direction, recipe"))
def world_credit(spark, read) -> DataFrame:
    """The simplest world that takes each direction of an IF or a phrase, kept by a ledger that has met the worlds kind by kind."""
    names = _worlds(spark).filter("world <> 'bare'").select(F.col("world").alias("run_id"), "kind", "outcomes")
    seq = F.when(F.col("kind") == "io", F.when(F.col("run_id") == "empty", 1).otherwise(2)).when(F.col("kind") == "sequence", F.substring_index("run_id", " ", -1).cast("int") + 2)
    order = names.withColumn("run_seq", F.coalesce(seq, F.when(F.col("run_id").startswith("READ:IN-FILE 23"), F.substring_index("run_id", " ", -1).cast("int") + 10), F.lit(100)).cast("long"))
    e = run_program(READER, names.drop("kind")).filter("kind <> 'LOOP'").join(order.select("run_id", "kind", "run_seq").withColumnRenamed("kind", "world_kind"), "run_id")
    taken = e.select("paragraph", "ordinal", "kind", F.col("result").alias("direction"), F.col("run_id").alias("recipe"), "run_seq", "world_kind")
    ledger = stores.credit(taken.filter("world_kind = 'io'"), taken.filter("world_kind = 'sequence'"))
    return stores.credit(ledger, taken.filter("world_kind = 'fault'")).drop("run_seq")


@query(listed([("D-OPEN", "WS-STATUS", "not injectable: WS-STATUS")], "plan, slot, reason"))
def plan_representability(spark, read) -> DataFrame:
    """Bindings of a program's plans that a harness which sets WS-FLAG and WS-QTY only can't hold."""
    bound = plans(_src(spark)).select(F.col("target").alias("plan"), F.explode(F.map_keys(F.from_json("state", "map<string,string>"))).alias("slot"))
    profile = values(spark, [("p", ["WS-FLAG", "WS-QTY"], [], "READ:IN-FILE", [], ["IN-KEY"])], "name string, injectable array<string>, replayable array<string>, op string, aliases array<string>, fields array<string>")
    return stores.unrepresentable(bound.select("plan", "slot", F.lit(None).cast("string").alias("op"), F.col("slot").alias("field")), profile)


@query(listed([("OPEN:IN-FILE", "OPEN-IN-FILE", "canonical"), ("READ:IN-FILE", "GET.RECORD", "alias")], "op, found, tier"))
def operation_resolution(spark, read) -> DataFrame:
    """A program's operations under the names that a harness has for them."""
    profile = values(spark, [("OPEN-IN-FILE", ["OPN"]), ("GET.RECORD", ["read_in_file"])], "op string, aliases array<string>")
    ops = source.operations(spark.createDataFrame([(READER,)], "source string")).select(F.col("operation").alias("op"))
    return stores.resolve_operations(ops, profile)


@query(listed(
    [("WS-X", i, c, v) for i, (c, v) in enumerate([("all-nines", "9"), ("overflow", "10"), ("negative-max", "-9"), ("zero", "0")])] + [("WS-Y", i, c, v) for i, (c, v) in enumerate([("width-exact", "A"), ("over-width", "AA"), ("trailing-space", " "), ("spaces", " ")])],
    "field, pos, category, value"))
def field_boundaries(spark, read) -> DataFrame:
    """Values at the edges of a program's own fields."""
    return evidence.boundaries(source.pictures(spark.createDataFrame([(ENDER,)], "source string"))).drop("program")
