"""Coverage, graph, provenance, solver and world operators with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardwalk.functions import cobol
from guardwalk.functions.conditions import condition
from guardwalk.operators import coverage, graph, sequences
from guardwalk.session import Rounds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def values(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    def say(v) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(map(say, v)) + "]::VARCHAR[]"
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(say(v) for v in r) + ")" for r in rows) + ")"


# ---- coverage

_EVENTS = """ev AS (
 SELECT l_orderkey * 10 + l_linenumber AS run_id, l_returnflag IN ('A', 'R') AS d1, l_quantity BETWEEN 1 AND 10 AS d2, l_quantity > 40 AS d3, rpad(l_linestatus, 2, ' ') = 'O ' AS d5 FROM lineitem),
e AS (SELECT run_id, 1 AS ordinal, 'IF' AS kind, d1 AS result FROM ev UNION ALL SELECT run_id, 2, 'WHEN', d2 FROM ev UNION ALL SELECT run_id, 3, 'WHEN', d3 FROM ev WHERE NOT d2
 UNION ALL SELECT run_id, 4, 'WHEN', NOT (d2 OR d3) FROM ev UNION ALL SELECT run_id, 5, 'IF', d5 FROM ev)"""


def decisions(read) -> DataFrame:
    """Directions of the flagship program: every lineitem is a run through five decisions."""
    x = read("lineitem")
    f = {"FLAG": (x.l_returnflag, "string"), "QTY": (x.l_quantity, "double"), "STATUS": (x.l_linestatus, "string")}
    d2, d3 = condition("QTY >= 1 AND <= 10", f), condition("QTY > 40", f)
    return coverage.observe_decisions(x, x.l_orderkey * 10 + x.l_linenumber, [
        (1, "IF", condition("FLAG = 'A' OR 'R'", f)), (2, "WHEN", d2), (3, "WHEN", F.when(~d2, d3)), (4, "WHEN", ~(d2 | d3)), (5, "IF", condition("STATUS = 'O '", f)),
    ])


@query(f"WITH {_EVENTS} SELECT ordinal, kind, result AS direction, count(DISTINCT run_id) AS n_runs, min(run_id) AS first_run FROM e GROUP BY 1, 2, 3")
def direction_coverage(spark, read) -> DataFrame:
    return decisions(read)


@query(f"WITH {_EVENTS}, s AS (SELECT DISTINCT ordinal, kind, result FROM e) SELECT b.ordinal, b.kind, b.direction FROM (SELECT * FROM (VALUES (1, 'IF'), (2, 'WHEN'), (3, 'WHEN'), (4, 'WHEN'), (5, 'IF'), (6, 'LOOP')) t(ordinal, kind), (VALUES (TRUE), (FALSE)) d(direction)) b LEFT JOIN s ON s.ordinal = b.ordinal AND s.kind = b.kind AND s.result = b.direction WHERE s.ordinal IS NULL")
def missing_directions(spark, read) -> DataFrame:
    branches = values(spark, [(1, "IF"), (2, "WHEN"), (3, "WHEN"), (4, "WHEN"), (5, "IF"), (6, "LOOP")], "ordinal int, kind string")
    return coverage.missing(branches, decisions(read))


@query("SELECT event_type, user_id % 7 AS g, bool_or(value > 0) AS only FROM events GROUP BY 1, 2 HAVING count(DISTINCT value > 0) = 1")
def one_way_only(spark, read) -> DataFrame:
    e = read("events").select("event_type", (F.col("user_id") % 7).alias("g"), (F.col("value") > 0).alias("direction"))
    return coverage.one_way(e, ("event_type", "g"))


@query("SELECT event_type, value > 50 AS direction, arg_min(user_id, event_id) AS recipe, min(event_id) AS run_seq FROM events GROUP BY 1, 2")
def first_recipe(spark, read) -> DataFrame:
    e = read("events").select("event_type", (F.col("value") > 50).alias("direction"), F.col("user_id").alias("recipe"), F.col("event_id").alias("run_seq"))
    return coverage.first_recipe(e, ["event_type", "direction"])


@query("SELECT count(*) AS n_runs, count(DISTINCT sha256(concat_ws('|', l_returnflag, l_linestatus, l_quantity::BIGINT)))::BIGINT AS n_recipes FROM lineitem")
def dedup_runs(spark, read) -> DataFrame:
    h = F.sha2(F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint")), 256)
    return read("lineitem").agg(F.count("*").alias("n_runs"), F.count_distinct(h).alias("n_recipes"))


@query("SELECT CASE WHEN o_totalprice IS NULL THEN 'unsolved' WHEN o_totalprice < 20000 THEN 'refused' WHEN o_orderstatus = 'F' THEN 'verified' WHEN o_orderstatus = 'P' THEN 'wrong_direction' ELSE 'target_not_reached' END AS stage, count(*) AS n FROM orders GROUP BY 1")
def dispositions(spark, read) -> DataFrame:
    """Every attempt ends in exactly one stage, the first that applies."""
    o = read("orders")
    s = F.when(o.o_totalprice.isNull(), "unsolved").when(o.o_totalprice < 20000, "refused").when(o.o_orderstatus == "F", "verified").when(o.o_orderstatus == "P", "wrong_direction").otherwise("target_not_reached")
    return o.groupBy(s.alias("stage")).agg(F.count("*").alias("n"))


@query("SELECT length(o_orderpriority)::BIGINT AS depth, count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS covered, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders GROUP BY 1")
def failure_by_depth(spark, read) -> DataFrame:
    ok = F.col("o_orderstatus") == "F"
    return read("orders").groupBy(F.length("o_orderpriority").cast("bigint").alias("depth")).agg(F.count("*").alias("attempts"), F.count_if(ok).alias("covered"), F.count_if(~ok).alias("failed"))


@query("SELECT CASE WHEN bool_or(rk = 1) THEN 'verified' WHEN bool_or(rk = 2) THEN 'wrong_direction' ELSE 'target_not_reached' END AS verdict, o_custkey FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS rk FROM orders) GROUP BY 2")
def direction_verdict(spark, read) -> DataFrame:
    """The best verdict over all worlds and states of a direction."""
    rank = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    best = read("orders").groupBy("o_custkey").agg(F.min(rank).alias("r"))
    return best.select("o_custkey", F.element_at(F.array(*map(F.lit, ("verified", "wrong_direction", "target_not_reached"))), F.col("r")).alias("verdict"))


@query("SELECT reason, n FROM (SELECT p_type AS reason, count(*) AS n FROM part GROUP BY 1)")
def reason_categories(spark, read) -> DataFrame:
    return read("part").groupBy(F.col("p_type").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query("SELECT token, list_sort(list(DISTINCT p_name)) AS names, count(DISTINCT p_name)::BIGINT AS n FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token NOT IN ('RECORD', 'AREA') GROUP BY 1")
def token_vocab(spark, read) -> DataFrame:
    t = read("part").select("p_name", F.explode(F.array_except(F.split("p_name", " "), F.array(F.lit("RECORD"), F.lit("AREA")))).alias("token"))
    return t.groupBy("token").agg(F.array_sort(F.collect_set("p_name")).alias("names"), F.count_distinct("p_name").alias("n"))


@query("SELECT event_type, v, rk FROM (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY covered DESC, seen DESC, v) AS rk FROM (SELECT event_type, floor(value / 10)::BIGINT AS v, max(user_id) AS covered, count(*) AS seen FROM events GROUP BY 1, 2)) WHERE rk <= 20")
def learned_rank(spark, read) -> DataFrame:
    """Learned values by coverage, then by how often they were seen; the twenty best of each field."""
    g = read("events").groupBy("event_type", F.floor(F.col("value") / 10).alias("v")).agg(F.max("user_id").alias("covered"), F.count("*").alias("seen"))
    r = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("covered"), F.desc("seen"), "v"))
    return g.withColumn("rk", r.cast("bigint")).filter("rk <= 20").select("event_type", "v", "rk")


@query("SELECT l_returnflag, quantile_disc(n, 0.5) AS lower_, (list_sort(list(n)))[count(*) // 2 + 1] AS median, max(n) AS most FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def needs_median(spark, read) -> DataFrame:
    """The upper median of sorted sizes."""
    g = read("lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    middle = lambda order: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY n{order})").cast("long")
    return g.groupBy("l_returnflag").agg(middle("").alias("lower_"), middle(" DESC").alias("median"), F.max("n").alias("most"))


_NEEDS = """WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS plan, n_name AS need FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
 r AS (SELECT 0 AS step, []::VARCHAR[] AS granted, NULL::VARCHAR AS capability
  UNION ALL SELECT step + 1, list_append(granted, need), need FROM (
   SELECT step, granted, need, row_number() OVER (ORDER BY gain DESC, CASE WHEN gain > 0 THEN 0 ELSE -n END, need) AS k FROM (
    SELECT step, granted, need, count(*) FILTER (left_ = 1) AS gain, count(*) AS n FROM (
     SELECT r.step, r.granted, n.plan, n.need, count(*) OVER (PARTITION BY n.plan) AS left_ FROM r JOIN n ON NOT list_contains(r.granted, n.need)) GROUP BY 1, 2, 3)) WHERE k = 1)"""


@query(f"{_NEEDS} SELECT r.step, r.capability, (SELECT count(DISTINCT plan) FROM n) - count(DISTINCT n.plan) AS unlocked FROM r LEFT JOIN n ON NOT list_contains(r.granted, n.need) WHERE r.step > 0 GROUP BY 1, 2")
def unlock_cover(spark, read) -> DataFrame:
    """Nations in the order in which dealing with them serves the most orders, with the orders served whole so far."""
    s = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    needs = read("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("plan")).agg(F.collect_set("n_name").alias("needs"))  # 25 nations at most
    got = coverage.unlock(needs)
    return values(spark, [(i + 1, c, n) for i, (c, n) in enumerate(got)], "step int, capability string, unlocked long")


# ---- graph

_EDGES = [
    ("MAIN", "INIT", 1, []), ("MAIN", "READ", 2, ["EOF = 'N'"]), ("MAIN", "WORK", 3, ["EOF = 'N'", "RC = 0"]), ("READ", "CHECK", 4, ["ST NOT = '00'"]), ("WORK", "CHECK", 5, []),
    ("WORK", "POST", 6, ["AMT > 0"]), ("POST", "WRITE", 7, []), ("CHECK", "ABEND", 8, ["ST > '10'"]), ("WRITE", "CHECK", 9, ["ST NOT = '00'"]), ("POST", "WORK", 10, ["RETRY = 'Y'"]), ("LOST", "WRITE", 11, []),
]
_ESQL = sql_values("edges", "caller, callee, seq, guards", _EDGES)


def _edges(spark) -> DataFrame:
    return values(spark, _EDGES, "caller string, callee string, seq long, guards array<string>")


@query(f"WITH RECURSIVE {_ESQL}, r AS (SELECT 'MAIN' AS paragraph, 0 AS depth UNION ALL SELECT callee, depth + 1 FROM r JOIN edges ON caller = paragraph WHERE depth < 11) SELECT paragraph, min(depth)::INTEGER AS depth FROM r GROUP BY 1")
def graph_depths(spark, read) -> DataFrame:
    return graph.depths(_edges(spark), "MAIN")


@query(f"""WITH RECURSIVE {_ESQL}, r AS (SELECT 'MAIN' AS paragraph, 0 AS depth, ['MAIN'] AS chain, 0 AS g, []::INTEGER[] AS seqs UNION ALL
 SELECT callee, depth + 1, list_append(chain, callee), g + len(guards), list_append(seqs, seq) FROM r JOIN edges ON caller = paragraph WHERE NOT list_contains(chain, callee))
 SELECT paragraph, depth::INTEGER AS depth, chain, g::BIGINT AS n_guards FROM (SELECT *, row_number() OVER (PARTITION BY paragraph ORDER BY depth, seqs) AS k FROM r) WHERE k = 1""")
def shortest_chain(spark, read) -> DataFrame:
    return graph.shortest_chains(_edges(spark), "MAIN")


@query(f"WITH {_ESQL} SELECT caller, callee, len(guards)::BIGINT AS weight FROM edges")
def guard_weight(spark, read) -> DataFrame:
    return _edges(spark).select("caller", "callee", F.size("guards").cast("bigint").alias("weight"))


_USES = [("MAIN", 1, "write", "RC"), ("MAIN", 2, "read", "EOF"), ("MAIN", 3, "call", "WORK"), ("WORK", 1, "read", "AMT"), ("WORK", 2, "read", "RC"), ("WORK", 3, "call", "CHECK"), ("WORK", 4, "write", "ST"), ("CHECK", 1, "read", "ST"), ("CHECK", 2, "write", "RC"), ("CHECK", 3, "read", "RC")]


@query(f"""WITH RECURSIVE {sql_values('uses', 'paragraph, pos, kind, field', _USES)}, fw AS (SELECT paragraph, field, min(pos) AS w FROM uses WHERE kind = 'write' GROUP BY 1, 2),
 l AS (SELECT u.paragraph, u.field FROM uses u LEFT JOIN fw ON fw.paragraph = u.paragraph AND fw.field = u.field WHERE u.kind = 'read' AND (w IS NULL OR u.pos <= w)
 UNION SELECT c.paragraph, l.field FROM l JOIN uses c ON c.kind = 'call' AND c.field = l.paragraph LEFT JOIN fw ON fw.paragraph = c.paragraph AND fw.field = l.field WHERE w IS NULL OR c.pos <= w) SELECT DISTINCT paragraph, field FROM l""")
def live_in(spark, read) -> DataFrame:
    return graph.live_in(_edges(spark), values(spark, _USES, "paragraph string, pos int, kind string, field string"))


_WRITERS = [("ST", 1, 10, "w1"), ("ST", 2, 25, "w2"), ("ST", 2, 40, "w3"), ("ST", 4, 80, "w4"), ("RC", 3, 60, "w5")]
_READS = [(1, "ST", 2, 30), (2, "ST", 2, 20), (3, "ST", 3, 61), (4, "RC", 1, 5), (5, "ST", 4, 79), (6, "XX", 1, 1)]


@query(f"""WITH {sql_values('w', 'field, r, line, writer', _WRITERS)}, {sql_values('x', 'read_id, field, r, line', _READS)},
 t AS (SELECT x.read_id, x.field, w.writer, w.r AS wr, w.line AS wl, CASE WHEN w.r = x.r AND w.line < x.line THEN 0 WHEN w.r < x.r THEN 1 ELSE 2 END AS tier FROM x LEFT JOIN w ON w.field = x.field)
 SELECT read_id, field, writer FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY tier, CASE WHEN tier = 2 THEN wr ELSE -wr END, CASE WHEN tier = 2 THEN wl ELSE -wl END) AS k FROM t) WHERE k = 1""")
def reaching_writer(spark, read) -> DataFrame:
    return graph.reaching_writers(values(spark, _WRITERS, "field string, rank int, line int, writer string"), values(spark, _READS, "read_id int, field string, rank int, line int"))


_MOVES = [("A", "B", "field"), ("B", "C", "field"), ("C", "X1", "literal"), ("D", "E", "field"), ("E", "D", "field"), ("E", "READ:F", "stub"), ("F", "G", "field")]


@query(f"""WITH RECURSIVE {sql_values('m', 'field, source, source_kind', _MOVES)}, r AS (SELECT f AS field, f AS at, 0 AS hops, [f] AS path FROM (VALUES ('A'), ('D'), ('F')) t(f)
 UNION ALL SELECT r.field, m.source, hops + 1, list_append(path, m.source) FROM r JOIN m ON m.field = r.at AND m.source_kind = 'field' WHERE NOT list_contains(path, m.source))
 SELECT DISTINCT r.field, coalesce(m.source, r.at) AS source, coalesce(m.source_kind, 'input') AS source_kind, r.hops::INTEGER AS hops FROM r LEFT JOIN m ON m.field = r.at WHERE m.source_kind IS NULL OR m.source_kind <> 'field'""")
def producer_walk(spark, read) -> DataFrame:
    return graph.producers(values(spark, _MOVES, "field string, source string, source_kind string"), values(spark, [("A",), ("D",), ("F",)], "field string"))


_LITERAL_WRITES = [("EOF", "'N'", "MAIN", None), ("EOF", "'Y'", "READ", "ST = '10'"), ("RC", "0", "INIT", None), ("RC", "8", "CHECK", "ST > '10'"), ("RC", "4", "WARN", "ST = '05'")]


@query(f"WITH {sql_values('w', 'field, value, paragraph, guard', _LITERAL_WRITES)} SELECT field, value, paragraph, guard, field = 'RC' AND value <> '0' OR field = 'EOF' AND value <> '''N''' AS blocks, NOT (field = 'RC' AND value <> '0' OR field = 'EOF' AND value <> '''N''') AS establishes FROM w")
def blocking_writes(spark, read) -> DataFrame:
    """Of a field's writes, those that break the wanted value and those that supply it."""
    w = values(spark, _LITERAL_WRITES, "field string, value string, paragraph string, guard string")
    want = values(spark, [("EOF", "'N'"), ("RC", "0")], "field string, want string")
    holds = cobol.compare(F.col("value"), "=", F.col("want"), "string", "string")
    return w.join(want, "field").select("field", "value", "paragraph", "guard", (~holds).alias("blocks"), holds.alias("establishes"))


_RANGE = [("A", 1), ("B", 2), ("C", 3), ("D", 4), ("E", 5)]


@query(f"WITH {sql_values('p', 'paragraph, pos', _RANGE)} SELECT a.paragraph AS first, z.paragraph AS last, list(m.paragraph ORDER BY m.pos) AS members FROM p a JOIN p z ON z.pos >= a.pos JOIN p m ON m.pos BETWEEN a.pos AND z.pos WHERE a.paragraph = 'B' AND z.paragraph = 'D' GROUP BY 1, 2")
def range_members(spark, read) -> DataFrame:
    """PERFORM A THRU Z runs the paragraphs from A to Z in source order."""
    p = values(spark, _RANGE, "paragraph string, pos int")
    ends = values(spark, [("B", "D")], "first string, last string").join(p.select(F.col("paragraph").alias("first"), F.col("pos").alias("lo")), "first").join(p.select(F.col("paragraph").alias("last"), F.col("pos").alias("hi")), "last")
    m = ends.join(p, F.col("pos").between(F.col("lo"), F.col("hi")))
    return m.groupBy("first", "last").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))), lambda x: x["paragraph"]).alias("members"))


@query(f"WITH {sql_values('p', 'paragraph, pos', _RANGE)} SELECT a.paragraph AS caller, b.paragraph AS callee, 'fallthrough' AS kind FROM p a JOIN p b ON b.pos = a.pos + 1 WHERE a.paragraph <> 'C'")
def fallthrough_edges(spark, read) -> DataFrame:
    """Control falls into the next paragraph unless the last statement always leaves (here C)."""
    p = values(spark, _RANGE, "paragraph string, pos int")
    n = F.lead("paragraph").over(Window.partitionBy(F.lit(1)).orderBy("pos"))  # one program's paragraphs
    return p.withColumn("callee", n).filter("callee IS NOT NULL AND paragraph <> 'C'").select(F.col("paragraph").alias("caller"), "callee", F.lit("fallthrough").alias("kind"))


# ---- solver and joins


@query("SELECT c_custkey, count(*) AS n, min(o_orderkey) AS first FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def rendezvous(spark, read) -> DataFrame:
    """A = B: the values both sides can hold."""
    j = read("customer").join(read("orders"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def separation(spark, read) -> DataFrame:
    """A != B: values only one side can hold."""
    return read("customer").join(read("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, max(p_partkey) AS below FROM orders JOIN part ON p_partkey < o_orderkey % 97 GROUP BY 1")
def ordering(spark, read) -> DataFrame:
    """A < B: the greatest value of one side below the other's. Only distinct ends meet, and they are looked up, not joined pair by pair."""
    from pyspark.sql import Window

    o = read("orders").select("o_orderkey", (F.col("o_orderkey") % 97).alias("at"))
    ends = o.select("at").distinct().select("at", F.lit(None).cast("long").alias("v")).union(read("part").filter("p_partkey < 97").select(F.col("p_partkey"), F.col("p_partkey")).distinct())
    w = Window.orderBy("at", F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    below = ends.withColumn("below", F.max("v").over(w)).filter("v IS NULL").select("at", "below")  # at most 97 ends and values
    return o.join(below, "at").filter("below IS NOT NULL").select("o_orderkey", "below")


_DOMAIN = [("ST", "'00'", 1), ("ST", "'10'", 2), ("ST", "'23'", 3), ("RC", "0", 1), ("RC", "4", 2), ("RC", "8", 3)]


@query("SELECT * FROM (VALUES (1, '10'), (2, '23'), (3, '00'), (4, '8'), (5, NULL)) t(atom, value)")
def witness_value(spark, read) -> DataFrame:
    """The first value of a field's ordered domain that satisfies an atom."""
    dom = values(spark, [(f, v.strip("'"), p) for f, v, p in _DOMAIN], "field string, value string, pos int")
    atoms = [(1, "ST", "!=", "00"), (2, "ST", ">", "10"), (3, "ST", "<", "10"), (4, "RC", ">", "4"), (5, "RC", ">", "8")]
    parts = [dom.filter((F.col("field") == f) & cobol.compare(F.col("value"), op, F.lit(c), "string", "string")).agg(F.min_by("value", "pos").alias("value")).select(F.lit(i).alias("atom"), "value") for i, f, op, c in atoms]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT * FROM (VALUES (1, 'all-nines', '99999'), (2, 'overflow', '100000'), (3, 'negative-max', '-99999'), (4, 'zero', '0'), (5, 'width-exact', 'AAAA'), (6, 'over-width', 'AAAAA'), (7, 'trailing-space', 'AAA '), (8, 'spaces', '    ')) t(pos, category, value)")
def boundary_candidates(spark, read) -> DataFrame:
    """Values on the edges of S9(5) and X(4)."""
    d, w = 5, 4
    n = [("all-nines", str(10**d - 1)), ("overflow", str(10**d)), ("negative-max", str(1 - 10**d)), ("zero", "0")]
    t = [("width-exact", "A" * w), ("over-width", "A" * (w + 1)), ("trailing-space", "A" * (w - 1) + " "), ("spaces", " " * w)]
    return values(spark, [(i + 1, *x) for i, x in enumerate(n + t)], "pos int, category string, value string")


@query("SELECT slot, pos, k FROM (SELECT *, row_number() OVER (ORDER BY r, slot) AS k FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY pos) AS r FROM (SELECT s.i AS slot, c.i AS pos FROM range(5) s(i), range(7) c(i) WHERE c.i <= s.i + 2))) WHERE k <= 12")
def family_round_robin(spark, read) -> DataFrame:
    """Candidates of the free slots in turns: rank within a slot, then slot; a family has twelve members."""
    s = spark.range(5).select(F.col("id").alias("slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") + 2)).alias("pos"))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("slot").orderBy("pos"))).orderBy("r", "slot").limit(12)
    return r.withColumn("k", F.row_number().over(Window.orderBy("r", "slot")).cast("bigint")).select("slot", "pos", "k")


@query("SELECT p_partkey, list_sort(list_filter(['a','b','c'], lambda x: NOT list_contains(string_split(lower(left(p_type, 3)), ''), x))) AS lacking FROM part")
def representability(spark, read) -> DataFrame:
    """What a harness would have to grant before it can hold a plan."""
    has = F.split(F.lower(F.left("p_type", F.lit(3))), "")
    return read("part").select("p_partkey", F.array_sort(F.array_except(F.array(F.lit("a"), F.lit("b"), F.lit("c")), has)).alias("lacking"))


# ---- outcome series and worlds


@query("SELECT event_id, user_id, n, CASE WHEN n <= 3 THEN event_type ELSE 'terminal' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def outcome_delivery(spark, read) -> DataFrame:
    """The n-th call of an operation gets the n-th outcome; beyond the series, the terminal."""
    e = sequences.runs(read("events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type", Rounds(spark))
    return e.select("event_id", "user_id", F.col("call").alias("n"), F.when(F.col("call") <= 3, F.col("event_type")).otherwise("terminal").alias("outcome"))


@query("SELECT event_id, event_type, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), TRUE) AS breaks FROM events")
def control_break(spark, read) -> DataFrame:
    """This key against the previous one of the same stream."""
    e = sequences.runs(read("events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type", Rounds(spark))
    return e.select("event_id", "event_type", F.col("fresh").alias("breaks"))


@query("SELECT n.i AS n_records, f.f AS field, p.i AS pos, (p.i % 3)::BIGINT AS candidate FROM range(1, 4) n(i), (VALUES ('K'), ('AMT')) f(f), range(3) p(i) WHERE p.i < n.i")
def sequence_worlds(spark, read) -> DataFrame:
    """One to three records, each taking the candidate of its position modulo the candidates, then the terminal."""
    w = spark.range(1, 4).select(F.col("id").alias("n_records"), F.explode(F.array(F.lit("K"), F.lit("AMT"))).alias("field"))
    return w.select("n_records", "field", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1)).alias("pos")).withColumn("candidate", F.col("pos") % 3)


_OPCODES = [("READ:A", c, k, p) for k, c in enumerate(("23", "35", "90")) for p in (1, 2)] + [("WRITE:B", c, k, 1) for k, c in enumerate(("22", "34", "90"))]


@query(f"WITH {sql_values('w', 'op, code, code_rank, pos', _OPCODES)} SELECT op, code, pos, k FROM (SELECT *, row_number() OVER (ORDER BY code_rank, pos, op) AS k FROM w) WHERE k <= 60")
def fault_worlds(spark, read) -> DataFrame:
    """One fault code at one call; sorted before the cap of sixty, so that the cap falls evenly on the operations."""
    w = values(spark, _OPCODES, "op string, code string, code_rank int, pos int")
    first = w.orderBy("code_rank", "pos", "op").limit(60)
    return first.withColumn("k", F.row_number().over(Window.orderBy("code_rank", "pos", "op")).cast("bigint")).select("op", "code", "pos", "k")


@query("SELECT o_orderkey, coalesce(t1.n_nationkey, t2.n_nationkey) AS nation, CASE WHEN t1.n_nationkey IS NOT NULL THEN 'exact' WHEN t2.n_nationkey IS NOT NULL THEN 'alias' ELSE 'none' END AS tier FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NATION_' ELSE 'nation-' END || (o_orderkey % 30) AS name FROM orders) o LEFT JOIN nation t1 ON t1.n_name = name LEFT JOIN nation t2 ON upper(replace(name, '-', '_')) = t2.n_name")
def work_list_resolution(spark, read) -> DataFrame:
    """Tiered lookups: the earlier tier wins."""
    o = read("orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "NATION_").otherwise("nation-"), (F.col("o_orderkey") % 30).cast("string")).alias("name"))
    n = read("nation")
    a = n.select(F.col("n_name").alias("x1"), F.col("n_nationkey").alias("k1"))
    b = n.select(F.col("n_name").alias("x2"), F.col("n_nationkey").alias("k2"))
    j = o.join(a, F.col("name") == F.col("x1"), "left").join(b, F.upper(F.replace("name", F.lit("-"), F.lit("_"))) == F.col("x2"), "left")
    return j.select("o_orderkey", F.coalesce("k1", "k2").alias("nation"), F.when(F.col("k1").isNotNull(), "exact").when(F.col("k2").isNotNull(), "alias").otherwise("none").alias("tier"))


@query(r"SELECT page_id, regexp_replace(upper(regexp_replace(url, '[^A-Za-z0-9]+', ':', 'g')), ':$', '') AS op FROM pages")
def op_alias(spark, read) -> DataFrame:
    """Operation names in canonical punctuation."""
    return read("pages").select("page_id", F.regexp_replace(F.upper(F.regexp_replace("url", "[^A-Za-z0-9]+", ":")), ":$", "").alias("op"))


@query("SELECT p_partkey, x AS prefix FROM (SELECT p_partkey, x, row_number() OVER (PARTITION BY p_partkey ORDER BY length(x) DESC) AS k FROM part JOIN (VALUES ('r'), ('re'), ('red'), ('s'), ('small'), ('b')) t(x) ON starts_with(p_name, x)) WHERE k = 1")
def longest_prefix(spark, read) -> DataFrame:
    """The longest stored prefix of a name, by equi-joins on its prefixes."""
    stored = values(spark, [(x,) for x in ("r", "re", "red", "s", "small", "b")], "prefix string")
    p = read("part").select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("p_name"), F.lit(5))), lambda i: F.substring(F.col("p_name"), F.lit(1), i))).alias("prefix"))
    return p.join(F.broadcast(stored), "prefix").groupBy("p_partkey").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


@query("SELECT user_id, arg_max(event_type, event_id) AS latest, count(*) AS entries FROM events GROUP BY 1")
def journal_latest(spark, read) -> DataFrame:
    """An append-only journal read as latest wins."""
    return read("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("latest"), F.count("*").alias("entries"))


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS literals FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def varying_selectors(spark, read) -> DataFrame:
    """Literals that differ between the call sites of one operation."""
    s = F.collect_set("o_orderstatus")
    return read("orders").groupBy("o_custkey").agg(F.array_sort(s).alias("literals")).filter("size(literals) > 1")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'FIXED' END AS seg, c_nationkey::VARCHAR AS nat FROM customer")
def overlay_states(spark, read) -> DataFrame:
    """A plan's fixed keys win over the overlay's."""
    over = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("nat"), F.col("c_nationkey").cast("string"))
    fixed = F.when(F.col("c_custkey") % 2 == 1, F.create_map(F.lit("seg"), F.lit("FIXED"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_from_entries(F.concat(F.map_entries(fixed), F.filter(F.map_entries(over), lambda e: ~F.array_contains(F.map_keys(fixed), e["key"]))))
    return read("customer").select("c_custkey", F.element_at(merged, "seg").alias("seg"), F.element_at(merged, "nat").alias("nat"))
