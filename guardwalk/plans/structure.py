"""Queries on the structure of graphs, records and sequences that the given tables hold, with the SQL that must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardwalk.functions import codecs
from guardwalk.operators import flow, graph, paths
from guardwalk.session import checkpoint_dir
from guardwalk.sources.records import Varying, read_varying, write_varying

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        ORACLES[f.__name__] = sql
        return f

    return put


# ---- a graph of trade: an order calls for its parts, a part for its latest supplier, a supplier for its first order


def trade(read) -> DataFrame:
    """(caller, callee, seq) of all lineitems."""
    x = read("lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = x.select(name("O:", "l_orderkey").alias("caller"), name("P:", "l_partkey").alias("callee")).distinct()
    last = x.groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("s"))
    first = x.groupBy("l_suppkey").agg(F.min("l_orderkey").alias("o"))
    return a.union(last.select(name("P:", "l_partkey"), name("S:", "s"))).union(first.select(name("S:", "l_suppkey"), name("O:", "o"))).withColumn("seq", F.xxhash64("caller", "callee"))


def nations(read) -> DataFrame:
    """(paragraph, op): a supplier's operation is its nation."""
    return read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("paragraph"), F.col("n_name").alias("op"))


_TRADE = """e AS (SELECT DISTINCT 'O:' || l_orderkey AS u, 'P:' || l_partkey AS v FROM lineitem
 UNION SELECT 'P:' || l_partkey, 'S:' || arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) FROM lineitem GROUP BY l_partkey
 UNION SELECT 'S:' || l_suppkey, 'O:' || min(l_orderkey) FROM lineitem GROUP BY l_suppkey)"""
_NATIONS = "ops AS (SELECT 'S:' || s_suppkey AS u, n_name AS op FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_REACHED = f"{_TRADE}, {_NATIONS}, x AS (SELECT u, op FROM ops UNION SELECT e.u, x.op FROM x JOIN e ON e.v = x.u)"


@query(f"WITH RECURSIVE {_REACHED} SELECT u AS paragraph, op FROM x")
def external_reach(spark, read) -> DataFrame:
    """Nations that every order, part and supplier reaches."""
    return flow.reach(trade(read), nations(read))


@query(f"WITH RECURSIVE {_REACHED} SELECT u AS paragraph, list_sort(list(op)) AS ops, count(*) AS n FROM x GROUP BY 1")
def route_options(spark, read) -> DataFrame:
    """What a route through each node obliges one to control, the cheapest first."""
    r = flow.reach(trade(read), nations(read))
    return r.groupBy("paragraph").agg(F.array_sort(F.collect_list("op")).alias("ops"), F.count("*").alias("n")).orderBy("n", "paragraph")


@query(f"WITH RECURSIVE {_REACHED} SELECT u AS paragraph, count(*) AS n_ops FROM x GROUP BY 1")
def reach_counts(spark, read) -> DataFrame:
    return flow.reach_counts(trade(read), nations(read))


@query(f"""WITH RECURSIVE {_TRADE}, s AS (SELECT DISTINCT u FROM e WHERE u LIKE 'S:%'),
 r AS (SELECT u AS a, u AS b FROM s UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b),
 to_s AS (SELECT u AS node, u AS s0 FROM s UNION SELECT e.u, to_s.s0 FROM to_s JOIN e ON e.v = to_s.node),
 m AS (SELECT r.b AS node, r.a AS s0 FROM r JOIN to_s ON to_s.node = r.b AND to_s.s0 = r.a),
 g AS (SELECT s0, min(node) AS component FROM m GROUP BY s0),
 n AS (SELECT u AS node FROM e UNION SELECT v FROM e)
 SELECT n.node, coalesce(min(g.component), n.node) AS component FROM n LEFT JOIN m ON m.node = n.node LEFT JOIN g ON g.s0 = m.s0 GROUP BY n.node""")
def strong_components(spark, read) -> DataFrame:
    """Orders, parts and suppliers that call for each other in a circle; every circle passes a supplier."""
    return flow.strong_components(trade(read))


_FROM = "'S:' || (SELECT min(l_suppkey) FROM lineitem)"
_DOM = f"""{_TRADE}, v0 AS (SELECT {_FROM} AS n UNION SELECT e.v FROM v0 JOIN e ON e.u = v0.n),
 w AS (SELECT n AS gone, {_FROM} AS n FROM v0 WHERE n <> {_FROM} UNION SELECT w.gone, e.v FROM w JOIN e ON e.u = w.n WHERE e.v <> w.gone),
 d AS (SELECT a.n AS node, b.n AS dom FROM v0 a JOIN v0 b ON b.n = {_FROM} OR NOT EXISTS (SELECT 1 FROM w WHERE w.gone = b.n AND w.n = a.n)),
 k AS (SELECT node, count(*) AS k FROM d GROUP BY node)"""


@query(f"""WITH RECURSIVE {_DOM} SELECT k.node, (SELECT d.dom FROM d JOIN k q ON q.node = d.dom WHERE d.node = k.node AND q.k = k.k - 1) AS idom, (k.k - 1)::INTEGER AS depth FROM k""")
def dominators(spark, read) -> DataFrame:
    """What every way from the first supplier to a node passes last before it."""
    first = read("lineitem").agg(F.min("l_suppkey")).first()[0]
    return flow.dominators(trade(read).select("caller", "callee"), f"S:{first}").drop("path")


@query(f"""WITH RECURSIVE {_TRADE}, r AS (SELECT {_FROM} AS n, 0 AS depth UNION SELECT e.v, r.depth + 1 FROM r JOIN e ON e.u = r.n WHERE r.depth < 400)
 SELECT n AS paragraph, min(depth)::INTEGER AS depth FROM r GROUP BY 1""")
def trade_depths(spark, read) -> DataFrame:
    first = read("lineitem").agg(F.min("l_suppkey")).first()[0]
    return graph.depths(trade(read), f"S:{first}")


# ---- a customer's orders as a program: an order is a paragraph, its lines are statements, which return, or pass to the next order, or end


def order_programs(read) -> DataFrame:
    """(program, paragraph, ordinal, kind, text, guards): returned lines end a run, accepted ones perform the customer's next order."""
    following = read("orders").join(read("lineitem").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey")
    nxt = following.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("all")).select("o_custkey", F.posexplode("all").alias("i", "o_orderkey"), F.col("all"))  # a customer's own orders
    named = nxt.select("o_custkey", "o_orderkey", F.get("all", F.col("i") + 1).alias("next"))
    guard = lambda c, text: F.when(c, F.lit(text))
    x = read("lineitem").join(named, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "STOP").when((F.col("l_returnflag") == "A") & F.col("next").isNotNull(), "PERFORM").otherwise("MOVE")
    guards = F.array_compact(F.array(guard(F.col("l_linestatus") == "O", "OPEN"), guard(F.col("l_quantity") > 25, "MANY"), guard(F.col("l_discount") >= 0.05, "CHEAP")))
    return x.select(F.col("o_custkey").cast("string").alias("program"), F.col("o_orderkey").cast("string").alias("paragraph"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("ordinal"), kind.alias("kind"), F.coalesce(F.col("next").cast("string"), F.lit("")).alias("text"), guards.alias("guards"))


_PROGRAM = """p AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
 st AS (SELECT p.c, p.o, p.k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INTEGER AS i, CASE WHEN l_returnflag = 'R' THEN 'STOP' WHEN l_returnflag = 'A' AND p.k > 1 THEN 'PERFORM' ELSE 'MOVE' END AS kind,
   (l_linestatus = 'O')::INT + 2 * (l_quantity > 25)::INT + 4 * (l_discount >= 0.05)::INT AS own FROM p JOIN lineitem ON l_orderkey = p.o),
 f AS (SELECT DISTINCT c, 0::BIGINT AS k, 0 AS mask, FALSE AS may, FALSE AS always, 0::BIGINT AS ways FROM p
  UNION ALL SELECT f.c, f.k + 1, coalesce(bit_and(CASE WHEN kind = 'STOP' THEN own ELSE own | f.mask END) FILTER (kind = 'STOP' OR kind = 'PERFORM' AND f.may), 0),
   coalesce(bool_or(kind = 'STOP' OR kind = 'PERFORM' AND f.may), FALSE), coalesce(bool_or(own = 0 AND (kind = 'STOP' OR kind = 'PERFORM' AND f.always)), FALSE),
   count(*) FILTER (kind = 'STOP' OR kind = 'PERFORM' AND f.may) * 1000 + CASE WHEN bool_or(kind = 'PERFORM' AND f.may AND f.ways <> 1000) THEN 1 ELSE 0 END
  FROM f JOIN st ON st.c = f.c AND st.k = f.k + 1 GROUP BY f.c, f.k)"""


@query(f"""WITH RECURSIVE {_PROGRAM} SELECT st.c::VARCHAR AS program, st.o::VARCHAR AS paragraph, st.i AS ordinal,
 list_sort(list_filter([CASE WHEN m & 1 > 0 THEN 'OPEN' END, CASE WHEN m & 2 > 0 THEN 'MANY' END, CASE WHEN m & 4 > 0 THEN 'CHEAP' END], lambda g: g IS NOT NULL)) AS guards,
 (kind = 'STOP' OR always OR ways = 1000) AS sure
 FROM (SELECT st.*, f.always, f.ways, CASE WHEN kind = 'STOP' THEN own ELSE own | f.mask END AS m FROM st JOIN f ON f.c = st.c AND f.k = st.k - 1 WHERE kind = 'STOP' OR kind = 'PERFORM' AND f.may) st""")
def ways_to_end(spark, read) -> DataFrame:
    """Where a customer's run may end, and what must hold for it, by dominators."""
    return paths.ways_to_end(order_programs(read)).withColumn("guards", F.array_sort("guards"))


# ---- records of varying length

#: order 9(18) COMP, customer 9(9) COMP, status X, lines 9(4) COMP; then a part, quantity S9(5) COMP-3 and price S9(9)V99 COMP-3 for every line.
ORDER = Varying(head=15, counter=13, entry=13)


def order_records(read) -> DataFrame:
    """(record) of every order with all its lines."""
    x = read("lineitem")
    line = F.concat(codecs.binary(F.col("l_partkey"), 4), codecs.packed(F.col("l_quantity").cast("long"), 3), codecs.packed(F.round(F.col("l_extendedprice") * 100).cast("long"), 6))
    entries = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("e")))).alias("lines"))  # an order's own lines
    o = read("orders").join(entries, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lines = F.coalesce("lines", F.filter(F.array(F.struct(F.lit(0).alias("l_linenumber"), F.lit(0).cast("long").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.lit(b"").alias("e"))), lambda _: F.lit(False)))
    table = F.aggregate(lines, F.lit(b""), lambda acc, e: F.concat(acc, e["e"]))
    head = F.concat(codecs.binary(F.col("o_orderkey"), 8), codecs.binary(F.col("o_custkey"), 4), F.col("o_orderstatus").cast("binary"), codecs.binary(F.size(lines), 2))
    return o.select(F.concat(head, table).alias("record"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, count(l_orderkey) OVER (PARTITION BY o_orderkey) AS n_lines,
 CASE WHEN l_orderkey IS NOT NULL THEN (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INTEGER END AS pos,
 l_partkey, l_quantity::BIGINT AS quantity, round(l_extendedprice * 100)::BIGINT AS cents FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def variable_records(spark, read) -> DataFrame:
    """Orders with all their lines, written as records of varying length and read back in seven partitions."""
    path = f"{checkpoint_dir(spark)}/orders-{uuid.uuid4().hex}"
    write_varying(order_records(read), path, ORDER, stride=1 << 14)
    r = F.col("record")
    part = lambda at, n: F.substring(r, at + 1, n)
    head = [codecs.unbinary(part(0, 8), 8).cast("long").alias("o_orderkey"), codecs.unbinary(part(8, 4), 4).cast("long").alias("o_custkey"), part(12, 1).cast("string").alias("o_orderstatus"), codecs.unbinary(part(13, 2), 2).cast("long").alias("n_lines")]
    told = read_varying(spark, path, ORDER, 7).select(*head, F.posexplode_outer(ORDER.occurrences(r)).alias("pos", "e"))
    e = lambda at, n: F.substring("e", at + 1, n)
    return told.select("o_orderkey", "o_custkey", "o_orderstatus", "n_lines", "pos", codecs.unbinary(e(0, 4), 4).cast("long").alias("l_partkey"), codecs.unpacked(e(4, 3)).alias("quantity"), codecs.unpacked(e(7, 6)).alias("cents"))
