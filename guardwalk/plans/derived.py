"""Queries on origins of bytes, conflicts of constraints and matched reads over the given tables, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardwalk.operators import domains, lineage, matching
from guardwalk.plans.structure import query

# ---- slices that events write into their users' records, and slices of what users are into the sources of these


def _slice(read, record: str, source: str, at: int, size: int, within: int) -> DataFrame:
    e = F.col("event_id")
    lo = e * at % within
    return read("events").select(F.col(record).cast("string").alias("record"), F.struct("ts", "event_id").alias("seq"), lo.alias("lo"), (lo + 1 + e * 31 % size).alias("hi"), F.col(source).cast("string").alias("source"), (e * 13 % 100).alias("source_lo"))


def _bytes(name: str, record: str, source: str, at: int, size: int, within: int) -> str:
    lo = f"event_id * {at} % {within}"
    return f"""{name} AS (SELECT record, b, max({{'ts': ts, 'event_id': event_id, 'source': source, 'shift': shift}}) AS v FROM (
 SELECT {record}::VARCHAR AS record, ts, event_id, {source}::VARCHAR AS source, event_id * 13 % 100 - {lo} AS shift, unnest(range({lo}, {lo} + 1 + event_id * 31 % {size})) AS b FROM events) GROUP BY 1, 2)"""


def _intervals(bytes_of: str, kept: str) -> str:
    """Runs of bytes with one value `v`, told apart by the places where it changes."""
    return f"""SELECT record, min(b) AS lo, max(b) + 1 AS hi, {kept} FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY record ORDER BY b) AS run FROM (
  SELECT *, CASE WHEN lag(b) OVER w = b - 1 AND lag(v) OVER w IS NOT DISTINCT FROM v THEN 0 ELSE 1 END AS fresh FROM {bytes_of} WINDOW w AS (PARTITION BY record ORDER BY b))) GROUP BY record, run"""


_USERS = ("user_id", "event_type", 7919, 60, 900)
_TYPES = ("event_type", "user_id", 17, 9, 150)


@query(f"WITH {_bytes('y', *_USERS)} {_intervals('y', 'any_value(v.event_id) AS event_id, any_value(v.source) AS source, min(b + v.shift) AS source_lo')}")
def byte_origins(spark, read) -> DataFrame:
    """Which event's slice every byte of a user's record holds at last."""
    return lineage.overlay(_slice(read, *_USERS)).select("record", "lo", "hi", F.col("seq.event_id").alias("event_id"), "source", "source_lo")


@query(f"""WITH {_bytes('y', *_USERS)}, {_bytes('i', *_TYPES)},
 z AS (SELECT y.record, y.b, {{'source': CASE WHEN i.b IS NULL THEN y.v.source ELSE i.v.source END, 'shift': y.v.shift + coalesce(i.v.shift, 0), 'deep': i.b IS NOT NULL}} AS v
  FROM y LEFT JOIN i ON i.record = y.v.source AND i.b = y.b + y.v.shift)
 {_intervals('z', 'any_value(v.source) AS source, min(b + v.shift) AS source_lo')}""")
def byte_origins_through(spark, read) -> DataFrame:
    """The same, followed through the event types' own records to the users whose bytes these hold."""
    return lineage.compose(lineage.overlay(_slice(read, *_USERS)), lineage.overlay(_slice(read, *_TYPES)))


# ---- a master and a transaction file in key order


@query("""WITH m AS (SELECT c_custkey AS k, c_name FROM customer WHERE c_acctbal > 0),
 t AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
 SELECT coalesce(t.k, m.k) AS custkey, CASE WHEN m.k IS NULL THEN 'no master' WHEN t.k IS NULL THEN 'no transaction' ELSE 'matched' END AS side,
  t.n AS occurrence, m.c_name, t.o_orderkey FROM m FULL JOIN t ON m.k = t.k""")
def matched_reads(spark, read) -> DataFrame:
    """Customers in credit, as masters, against urgent finished orders."""
    m = read("customer").filter("c_acctbal > 0").withColumnRenamed("c_custkey", "custkey")
    t = read("orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "custkey")
    out = matching.balance_line(m, t, "custkey", ["o_orderdate", "o_orderkey"])
    return out.select("custkey", "side", "occurrence", "master.c_name", "transaction.o_orderkey")


# ---- an order's lines as fields: what quantities may be, if returned lines were too small, accepted ones large enough, and every line holds more than the one before it


def quantities(read) -> DataFrame:
    """(plan, id, left, op, right, value) of every order and its lines in their order; each is one more than, or as much as, the one before by whether it is still open."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")  # an order's own lines
    x = read("lineitem").withColumn("k", F.row_number().over(w))
    name = lambda p, k: F.concat(F.lit(p), F.lpad(k.cast("string"), 3, "0"))
    k, q, nothing = F.col("k"), F.col("l_quantity").cast("long"), F.lit(None)
    own = F.when(F.col("l_returnflag") == "R", ">").when(F.col("l_returnflag") == "A", "<=").otherwise("<>")
    row = lambda *of: F.struct(*[c.alias(n) for c, n in zip(of, ("id", "left", "op", "right", "value"), strict=True)])
    a = row(name("own", k), name("Q", k), own, nothing.cast("string"), q)
    b = row(name("up", k), name("Q", k - 1), F.when(F.col("l_linestatus") == "O", "<").otherwise("<="), name("Q", k), nothing.cast("long"))
    return x.select(F.col("l_orderkey").alias("plan"), F.inline(F.when(k > 1, F.array(a, b)).otherwise(F.array(a))))


_NAME = "'{}' || lpad({}::VARCHAR, 3, '0')".format


@query(f"""WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, l_quantity::BIGINT AS q, (l_linestatus = 'O')::BIGINT AS d FROM lineitem),
 y AS (SELECT l_orderkey AS plan, k, d, max(k) OVER (PARTITION BY l_orderkey) AS n, lead(d) OVER (PARTITION BY l_orderkey ORDER BY k) AS next_d,
  CASE WHEN l_returnflag = 'R' THEN q + 1 END AS least, CASE WHEN l_returnflag = 'A' THEN q END AS most, CASE WHEN l_returnflag NOT IN ('R', 'A') THEN q END AS gone, {_NAME('own', 'k')} AS own, {_NAME('up', 'k')} AS up FROM x),
 s AS (SELECT *, CASE WHEN coalesce(least, 1) > 1 THEN least WHEN gone = 1 THEN 2 ELSE 1 END AS alone, CASE WHEN coalesce(least, 1) > 1 OR gone = 1 THEN [own] ELSE []::VARCHAR[] END AS why FROM y),
 f AS (SELECT plan, k, n, alone AS lo, why FROM s WHERE k = 1
  UNION ALL SELECT s.plan, s.k, s.n, CASE WHEN f.lo + s.d <= s.alone THEN s.alone WHEN f.lo + s.d = s.gone THEN f.lo + s.d + 1 ELSE f.lo + s.d END,
   CASE WHEN f.lo + s.d <= s.alone THEN s.why WHEN f.lo + s.d = s.gone THEN list_concat(f.why, [s.up, s.own]) ELSE list_concat(f.why, [s.up]) END FROM f JOIN s ON s.plan = f.plan AND s.k = f.k + 1),
 h AS (SELECT plan, k, CASE WHEN coalesce(most, 60) < 60 THEN most WHEN gone = 60 THEN 59 ELSE 60 END AS hi FROM s WHERE k = n
  UNION ALL SELECT s.plan, s.k, least(CASE WHEN coalesce(s.most, 60) < 60 THEN s.most WHEN s.gone = 60 THEN 59 ELSE 60 END, CASE WHEN h.hi - s.next_d = s.gone THEN h.hi - s.next_d - 1 ELSE h.hi - s.next_d END) FROM h JOIN s ON s.plan = h.plan AND s.k = h.k - 1),
 c AS (SELECT f.plan, list_sort(list_concat(f.why, CASE WHEN s.most < f.lo THEN [s.own] ELSE []::VARCHAR[] END)) AS ids FROM f JOIN s ON s.plan = f.plan AND s.k = f.k WHERE f.lo > least(coalesce(s.most, 60), 60)
  UNION ALL SELECT f.plan, list_sort(f.why) FROM f WHERE f.lo > 60),
 m AS (SELECT plan, arg_min(list_distinct(ids), (len(list_distinct(ids)), ids)) AS ids FROM c GROUP BY plan)
 SELECT f.plan, {_NAME('Q', 'f.k')} AS field, f.lo, h.hi, NULL::VARCHAR AS conflict FROM f JOIN h ON h.plan = f.plan AND h.k = f.k WHERE f.plan NOT IN (SELECT plan FROM m)
 UNION ALL SELECT plan, NULL, NULL, NULL, array_to_string(list_sort(ids), ',') FROM m""")
def slot_conflicts(spark, read) -> DataFrame:
    """What quantity every line of an order may have, from 1 to 60, or which of the order's demands conflict."""
    return domains.solve(quantities(read), 1, 60).withColumn("conflict", F.array_join("conflict", ","))
