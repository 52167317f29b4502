"""Scalar, predicate, codec and table operators over the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardwalk.functions import cobol, codecs
from guardwalk.functions.conditions import condition, first_match

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    """Register a function of (read,) where read(table) gives a DataFrame."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[key] = sql
        return f

    return put


def long(c, name: str):
    return c.cast("bigint").alias(name)


# ---- conditions


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'middle' WHEN o_orderstatus = 'F' OR o_orderstatus = 'P' THEN 'large-closed' ELSE 'large-open' END AS arm FROM orders")
def when_first_match(read) -> DataFrame:
    o = read("orders")
    f = {"PRICE": (o.o_totalprice, "double"), "STATUS": (o.o_orderstatus, "string")}
    return o.select("o_orderkey", first_match([("PRICE < 50000", "small"), ("PRICE < 150000", "middle"), ("STATUS = 'F' OR 'P'", "large-closed")], f, "large-open").alias("arm"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 1 AND 10 AND l_returnflag = 'R' THEN 1 WHEN l_quantity BETWEEN 11 AND 30 THEN 2 ELSE 0 END AS arm FROM lineitem")
def when_range_also(read) -> DataFrame:
    x = read("lineitem")
    f = {"Q": (x.l_quantity, "double"), "R": (x.l_returnflag, "string")}
    return x.select("l_orderkey", "l_linenumber", first_match([("Q >= 1 AND Q <= 10 AND R = 'R'", 1), ("Q >= 11 AND <= 30", 2)], f, 0).alias("arm"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND NOT (o_totalprice > 100000 AND o_totalprice < 200000)")
def abbreviated_relation(read) -> DataFrame:
    o = read("orders")
    f = {"STATUS": (o.o_orderstatus, "string"), "PRICE": (o.o_totalprice, "double")}
    return o.filter(condition("STATUS = 'F' OR 'P'", f) & condition("NOT (PRICE > 100000 AND < 200000)", f)).select("o_orderkey")


@query("SELECT o_orderkey, NOT (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS calm, o_totalprice >= 100000 AS dear FROM orders")
def relation_words(read) -> DataFrame:
    o = read("orders")
    f = {"PRI": (o.o_orderpriority, "string"), "PRICE": (o.o_totalprice, "double")}
    return o.select("o_orderkey", condition("PRI NOT = ('1-URGENT' AND '2-HIGH')", f).alias("calm"), condition("PRICE IS NOT LESS THAN 100000", f).alias("dear"))


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS heavy, c_nationkey BETWEEN 3 AND 9 AS near FROM customer")
def level88(read) -> DataFrame:
    c = read("customer")
    names = {"HEAVY": ("SEG", ["BUILDING", "MACHINERY"]), "NEAR": ("NATION", [(3, 9)])}
    f = {"SEG": (c.c_mktsegment, "string"), "NATION": (c.c_nationkey, "int")}
    return c.select("c_custkey", condition("HEAVY", f, names).alias("heavy"), condition("NEAR", f, names).alias("near"))


@query("SELECT p_partkey, p_name = 'A OR B' AS hit FROM part")
def quoted_connectives(read) -> DataFrame:
    p = read("part")
    return p.select("p_partkey", condition("NAME = 'A OR B'", {"NAME": (p.p_name, "string")}).alias("hit"))


@query(r"SELECT event_id, regexp_matches(v, '^\s*[+-]*[0-9]+\s*$') AS is_numeric FROM (SELECT event_id, regexp_extract(props, ': ([^}]*)', 1) AS v FROM events)")
def class_numeric(read) -> DataFrame:
    e = read("events")
    return e.select("event_id", cobol.class_test(F.regexp_extract("props", ": ([^}]*)", 1), "NUMERIC").alias("is_numeric"))


@query(r"SELECT n_nationkey, regexp_matches(replace(n_name, '_', ' '), '^\s*[A-Za-z][A-Za-z\s]*$') AS alphabetic, regexp_matches(left(n_name, 6), '^[A-Z]+$') AS upper_only, FALSE AS lower_only FROM nation")
def class_alpha(read) -> DataFrame:
    n = read("nation")
    t = cobol.class_test
    return n.select("n_nationkey", t(F.replace("n_name", F.lit("_"), F.lit(" ")), "ALPHABETIC").alias("alphabetic"), t(F.left("n_name", F.lit(6)), "ALPHABETIC-UPPER").alias("upper_only"), t(n.n_name, "ALPHABETIC-LOWER").alias("lower_only"))


@query("SELECT c_custkey, c_acctbal > 0 AS positive, c_acctbal < 0 AS negative, c_acctbal = 0 AS zero FROM customer")
def class_sign(read) -> DataFrame:
    c = read("customer")
    return c.select("c_custkey", *[cobol.class_test(c.c_acctbal, k.upper()).alias(k) for k in ("positive", "negative", "zero")])


@query("SELECT c_custkey, rpad(c_mktsegment, 20, ' ') = rpad('BUILDING   ', 20, ' ') AS same, rpad(c_mktsegment, 20, ' ') < rpad('HOUSE', 20, ' ') AS before FROM customer")
def padded_compare(read) -> DataFrame:
    c = read("customer")
    p = lambda op, x: cobol.compare(c.c_mktsegment, op, F.lit(x), "string", "string")
    return c.select("c_custkey", p("=", "BUILDING   ").alias("same"), p("<", "HOUSE").alias("before"))


@query("SELECT event_id, CASE WHEN try_cast(trim(t) AS DOUBLE) IS NOT NULL THEN try_cast(trim(t) AS DOUBLE) >= 50 ELSE trim(t) >= '50' END AS at_least FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE ' ' || regexp_extract(props, '([0-9]+)', 1) || ' ' END AS t FROM events)")
def mixed_compare(read) -> DataFrame:
    e = read("events")
    t = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), F.regexp_extract("props", "([0-9]+)", 1), F.lit(" ")))
    return e.select("event_id", cobol.compare(t, ">=", F.lit(50), "string", "int").alias("at_least"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN TRUE ELSE FALSE END AS is_low FROM part")
def figurative_widen(read) -> DataFrame:
    p = read("part")
    v = F.when(p.p_partkey % 2 == 0, F.repeat(F.lit("\x00"), 5)).otherwise(F.lit("AAAAA"))
    return p.select("p_partkey", cobol.compare(v, "=", F.lit("\x00"), "string", "string").alias("is_low"))


# ---- stores and arithmetic


@query("SELECT o_orderkey, (o_orderkey % 100)::DECIMAL(2,0) AS stored FROM orders")
def move_num_truncate(read) -> DataFrame:
    return read("orders").select("o_orderkey", cobol.store_number(F.col("o_orderkey"), 2, 0).alias("stored"))


@query("SELECT p_partkey, rpad(substr(p_name, 1, 5), 5, ' ') AS l, lpad(right(p_name, 5), 5, ' ') AS r FROM part")
def move_alnum_truncate(read) -> DataFrame:
    p = read("part")
    return p.select("p_partkey", cobol.move_text(p.p_name, 5).alias("l"), cobol.move_text(p.p_name, 5, True).alias("r"))


@query("SELECT l_orderkey, l_linenumber, (floor(l_extendedprice::DECIMAL(18,2) * 10)::BIGINT % 100000 / 10.0)::DECIMAL(5,1) AS stored FROM lineitem")
def numeric_store_scale(read) -> DataFrame:
    return read("lineitem").select("l_orderkey", "l_linenumber", cobol.store_number(F.col("l_extendedprice").cast("decimal(18,2)"), 4, 1).alias("stored"))


_V = "(CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(18,2))"
_A = f"abs({_V})"
_S = f"(CASE WHEN {_V} < 0 THEN -1 ELSE 1 END)"


@query(f"""SELECT l_orderkey, l_linenumber, ({_S} * floor({_A} + 0.5))::BIGINT AS nearest, ({_S} * floor({_A}))::BIGINT AS trunc,
 round_even({_V}, 0)::BIGINT AS even, ({_S} * ceil({_A} - 0.5))::BIGINT AS toward_zero, ceil({_V})::BIGINT AS greater, floor({_V})::BIGINT AS lesser, ({_S} * ceil({_A}))::BIGINT AS away FROM lineitem""")
def rounded_modes(read) -> DataFrame:
    d = lambda c: F.col(c).cast("decimal(18,2)")
    v = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1) * d("l_extendedprice") * d("l_discount")
    modes = {"nearest": "NEAREST-AWAY-FROM-ZERO", "trunc": "TRUNCATION", "even": "NEAREST-EVEN", "toward_zero": "NEAREST-TOWARD-ZERO", "greater": "TOWARD-GREATER", "lesser": "TOWARD-LESSER", "away": "AWAY-FROM-ZERO"}
    return read("lineitem").select("l_orderkey", "l_linenumber", *[long(cobol.rounded(v, 0, m), k) for k, m in modes.items()])


@query("SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 100000 THEN -1.0 ELSE o_totalprice END AS kept, abs(o_totalprice) >= 100000 AS size_error FROM orders")
def size_error(read) -> DataFrame:
    e = cobol.size_error(F.col("o_totalprice"), 5)
    return read("orders").select("o_orderkey", F.when(e, F.lit(-1.0)).otherwise(F.col("o_totalprice")).alias("kept"), e.alias("size_error"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice / l_discount END, 4) AS q FROM lineitem")
def arith_div_zero(read) -> DataFrame:
    return read("lineitem").select("l_orderkey", "l_linenumber", F.round(cobol.divide(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("q"))


@query("SELECT o_orderkey, (x - 7 * floor(x / 7.0))::BIGINT AS m, (x % 7)::BIGINT AS r, floor(x / 10.0)::BIGINT AS i FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -o_custkey END AS x FROM orders)")
def mod_rem_integer(read) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    return read("orders").select("o_orderkey", long(cobol.fn_mod(x, F.lit(7)), "m"), long(cobol.fn_rem(x, F.lit(7)), "r"), long(F.floor(x / 10), "i"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT // 7)::BIGINT AS quotient, (l_quantity::BIGINT - 7 * (l_quantity::BIGINT // 7))::BIGINT AS remainder FROM lineitem")
def divide_remainder(read) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    t = F.expr("cast(l_quantity as bigint) div 7")
    return read("lineitem").select("l_orderkey", "l_linenumber", t.alias("quotient"), (q - 7 * t).alias("remainder"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_tax * 100, 20) AS hi, least(l_quantity, l_tax * 100, 20) AS lo FROM lineitem")
def max_min(read) -> DataFrame:
    a = [F.col("l_quantity"), F.col("l_tax") * 100, F.lit(20.0)]
    return read("lineitem").select("l_orderkey", "l_linenumber", F.greatest(*a).alias("hi"), F.least(*a).alias("lo"))


# ---- texts


@query(r"SELECT doc_id, len(regexp_extract_all(text, 'en'))::BIGINT AS n_all, (length(text) - length(regexp_replace(text, '^(Th)*', '')))::BIGINT // 2 AS n_leading, length(text)::BIGINT AS n_chars FROM documents")
def inspect_tally(read) -> DataFrame:
    t = F.col("text")
    return read("documents").select("doc_id", long(cobol.tally(t, "ALL", "en"), "n_all"), long(cobol.tally(t, "LEADING", "Th"), "n_leading"), long(cobol.tally(t, "CHARACTERS"), "n_chars"))


@query("SELECT doc_id, md5(replace(text, 'th', '##')) AS every, md5(CASE WHEN instr(text, 'an') > 0 THEN substr(text, 1, instr(text, 'an') - 1) || '__' || substr(text, instr(text, 'an') + 2) ELSE text END) AS first, md5(CASE WHEN text LIKE 'T%' THEN 't' || substr(text, 2) ELSE text END) AS leading FROM documents WHERE text NOT LIKE 'TT%'")
def inspect_replace(read) -> DataFrame:
    t = F.col("text")
    r = cobol.replacing
    return read("documents").filter("text NOT LIKE 'TT%'").select("doc_id", F.md5(r(t, "ALL", "th", "##")).alias("every"), F.md5(r(t, "FIRST", "an", "__")).alias("first"), F.md5(r(t, "LEADING", "T", "t")).alias("leading"))


@query("SELECT n_nationkey, translate(n_name, 'NATIO_', 'natioo') AS c FROM nation")
def inspect_convert(read) -> DataFrame:
    return read("nation").select("n_nationkey", cobol.converting(F.col("n_name"), "NATIO_", "natio").alias("c"))


@query("""SELECT page_id, (CASE WHEN q > 0 THEN length(url) - q ELSE 0 END)::BIGINT AS after_q, (CASE WHEN q > 0 THEN q - 1 ELSE length(url) END)::BIGINT AS before_q, (CASE WHEN q > 0 THEN len(regexp_extract_all(substr(url, q + 1), '=')) ELSE 0 END)::BIGINT AS eq_after
FROM (SELECT *, instr(url, '?') AS q FROM pages)""")
def inspect_region(read) -> DataFrame:
    u = F.col("url")
    return read("pages").select("page_id", long(cobol.tally(u, "CHARACTERS", after="?"), "after_q"), long(cobol.tally(u, "CHARACTERS", before="?"), "before_q"), long(cobol.tally(u, "ALL", "=", after="?"), "eq_after"))


@query("SELECT c_custkey, rpad(split_part(c_name, '#', 1) || '/' || c_mktsegment, 20, ' ') AS s, length(split_part(c_name, '#', 1) || '/' || c_mktsegment) > 20 AS overflow FROM customer")
def string_delimited(read) -> DataFrame:
    s, over = cobol.string_into([(F.col("c_name"), "#"), (F.lit("/"), None), (F.col("c_mktsegment"), None)], 20)
    return read("customer").select("c_custkey", s.alias("s"), over.alias("overflow"))


@query(r"SELECT page_id, p[1] AS f1, p[2] AS f2, p[3] AS f3, least(len(p), 3)::BIGINT AS filled FROM (SELECT page_id, string_split_regex(url, '/|\?') AS p FROM pages)")
def unstring(read) -> DataFrame:
    f, n = cobol.unstring(F.col("url"), ["/", "?"], 3)
    return read("pages").select("page_id", *[c.alias(f"f{i + 1}") for i, c in enumerate(f)], long(n, "filled"))


@query("SELECT p_partkey, substr(p_name, 2, 3) AS part, substr(p_name, 1, 1) || 'XY ' || substr(p_name, 5) AS whole FROM part")
def refmod_read_write(read) -> DataFrame:
    n = F.col("p_name")
    return read("part").select("p_partkey", cobol.refmod(n, 2, 3).alias("part"), cobol.refmod_set(n, 2, 3, F.lit("XY")).alias("whole"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -v ELSE v END AS n FROM (SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS v FROM events)")
def numval(read) -> DataFrame:
    d = F.regexp_extract("props", "([0-9]+)", 1)
    t = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" -"), d)).when(F.col("event_id") % 2 == 0, F.concat(d, F.lit("CR "))).otherwise(F.concat(F.lit("$"), d))
    return read("events").select("event_id", cobol.numval(t).alias("n"))


@query("SELECT event_id, (CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 0 END)::BIGINT AS bad FROM events")
def test_numval(read) -> DataFrame:
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.lit(" 12.5-")).when(k == 1, F.lit("12x4")).when(k == 2, F.lit("   ")).otherwise(F.lit("+1,000"))
    return read("events").select("event_id", long(cobol.test_numval(t), "bad"))


@query("SELECT o_orderkey, datediff('day', DATE '1600-12-31', o_orderdate::DATE)::BIGINT AS days, strftime(o_orderdate, '%Y%m%d')::BIGINT AS again, 0::BIGINT AS invalid FROM orders")
def integer_of_date(read) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    n = cobol.integer_of_date(d)
    return read("orders").select("o_orderkey", long(n, "days"), long(cobol.date_of_integer(n), "again"), long(cobol.integer_of_date(F.lit(20231345)), "invalid"))


@query(r"SELECT p_partkey, regexp_replace('  ' || p_name || E'\t ', '^\s+|\s+$', '', 'g') AS trimmed, upper(p_name) AS up, lower(p_brand) AS low, reverse(p_name) AS rev, length(p_name)::BIGINT AS n, (ascii(p_name) + 1)::BIGINT AS ord FROM part")
def text_functions(read) -> DataFrame:
    n = F.col("p_name")
    return read("part").select("p_partkey", cobol.strip(F.concat(F.lit("  "), n, F.lit("\t "))).alias("trimmed"), F.upper(n).alias("up"), F.lower("p_brand").alias("low"), F.reverse(n).alias("rev"), long(F.length(n), "n"), long(F.ascii(n) + 1, "ord"))


@query("SELECT p_partkey, p_size, repeat('AB', 3) AS filled, 0 AS number, ' ' AS blank FROM part")
def initialize_and_fill(read) -> DataFrame:
    """MOVE ALL 'AB' fills the receiver; INITIALIZE sets numbers to 0 and texts to blanks."""
    r = F.struct(F.col("p_size").alias("number"), F.lit("x").alias("blank")).withField("number", F.lit(0)).withField("blank", F.lit(" "))
    return read("part").withColumn("r", r).select("p_partkey", "p_size", F.substring(F.repeat(F.lit("AB"), 6), F.lit(1), F.lit(6)).alias("filled"), F.col("r.number").alias("number"), F.col("r.blank").alias("blank"))


@query("SELECT a.p_partkey, count(*) FILTER (b.p_brand < a.p_brand)::BIGINT AS ascii_before, count(*) FILTER (translate(b.p_brand, ' abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', ' 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') < translate(a.p_brand, ' abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', ' 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'))::BIGINT AS ebcdic_before FROM part a, (SELECT DISTINCT p_brand FROM part) b GROUP BY 1")
def collation_flip(read) -> DataFrame:
    """The place of a brand among the distinct brands in either code page."""
    from pyspark.sql import Window

    p = read("part").select("p_partkey", "p_brand")
    brands = p.select("p_brand").distinct()
    before = lambda key: F.row_number().over(Window.orderBy(key)) - 1  # noqa: E731  distinct brands are a dimension
    ranked = brands.select("p_brand", long(before(F.col("p_brand")), "ascii_before"), long(before(cobol.ebcdic_key(F.col("p_brand"))), "ebcdic_before"))
    return p.join(ranked, "p_brand").select("p_partkey", "ascii_before", "ebcdic_before")


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[0-9]') THEN 'digit' WHEN regexp_matches(p_name, '^[A-Z]') THEN 'upper' WHEN regexp_matches(p_name, '^[a-z]') THEN 'lower' END AS k FROM part")
def char_class(read) -> DataFrame:
    return read("part").select("p_partkey", cobol.char_class(F.col("p_name")).alias("k"))


# ---- codecs and tables


@query("SELECT o_orderkey, lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') || CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'D' END AS hex, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 10000000 ELSE -(o_orderkey % 10000000) END AS back FROM orders")
def packed_codec(read) -> DataFrame:
    u = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    b = codecs.packed(u, 4)
    return read("orders").select("o_orderkey", F.hex(b).alias("hex"), codecs.unpacked(b).alias("back"))


@query("SELECT o_orderkey, printf('%08X', ((x % 4294967296 + 4294967296) % 4294967296)::BIGINT) AS hex, x AS back FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS x FROM orders)")
def binary_codec(read) -> DataFrame:
    u = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    b = codecs.binary(u, 4)
    return read("orders").select("o_orderkey", F.hex(b).alias("hex"), codecs.unbinary(b, 4).alias("back"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN t ELSE left(t, 5) || chr(112 + right(t, 1)::INT) END AS d, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS back, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END || t AS apart
FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 6, '0') AS t FROM orders WHERE o_orderkey < 1000000)""")
def overpunch(read) -> DataFrame:
    """One width for the column: six digits, or more where an id needs them."""
    o = read("orders")
    width = max(6, o.agg(F.max(F.length(F.abs("o_orderkey").cast("string")))).first()[0] or 0)
    u = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    d = codecs.display(u, width)
    return o.select("o_orderkey", d.alias("d"), codecs.undisplay(d).alias("back"), codecs.display(u, width, separate="LEADING").alias("apart"))


@query("SELECT name, off::BIGINT AS off, len::BIGINT AS len FROM (VALUES ('REC', 0, 37), ('ID', 0, 4), ('NAME', 4, 10), ('NAME-X', 4, 10), ('BAL', 14, 5), ('TAB', 19, 18), ('QTY', 19, 2), ('AMT', 21, 4)) t(name, off, len)")
def record_layout(read) -> DataFrame:
    i = codecs.Item
    rec = i("REC", children=[i("ID", "9(9)", "COMP"), i("NAME", "X(10)"), i("NAME-X", "X(10)", redefines="NAME"), i("BAL", "S9(7)V99", "COMP-3"), i("TAB", occurs=3, children=[i("QTY", "9(4)", "BINARY"), i("AMT", "S999", sign="LEADING SEPARATE")])])
    places = codecs.layout(rec)
    return read("region").sparkSession.createDataFrame([(p.name, p.offset, p.length) for p in places], "name string, off long, len long")


@query("SELECT c_custkey, lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || rpad(c_mktsegment, 12, ' ') || lpad(c_nationkey::VARCHAR, 3, '0') AS rec FROM customer")
def fixed_width_writer(read) -> DataFrame:
    return read("customer").select("c_custkey", F.concat(codecs.display(F.col("c_custkey"), 6, signed=False), cobol.move_text(F.col("c_mktsegment"), 12), codecs.display(F.col("c_nationkey"), 3, signed=False)).alias("rec"))


@query("SELECT p_partkey, substr(p_brand || rpad(p_type, 10, ' '), 1, 6) AS tag, substr(p_brand || rpad(p_type, 10, ' '), 7, 4) AS rest FROM part")
def redefines_view(read) -> DataFrame:
    """Two views of one record's bytes."""
    rec = F.concat("p_brand", cobol.move_text(F.col("p_type"), 10)).cast("binary")
    return read("part").select("p_partkey", F.substring(rec, 1, 6).cast("string").alias("tag"), F.substring(rec, 7, 4).cast("string").alias("rest"))


_TAB = "SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS q FROM lineitem GROUP BY 1"


def _table(read) -> DataFrame:
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return read("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "l_quantity"))), lambda x: x["l_quantity"]).alias("q"))


@query(f"SELECT l_orderkey, q[3] AS third, q[least(len(q), 99)] AS held FROM (SELECT l_orderkey, q FROM ({_TAB})) WHERE len(q) >= 3")
def occurs_element(read) -> DataFrame:
    return _table(read).filter("size(q) >= 3").select("l_orderkey", codecs.occurrence(F.col("q"), F.lit(3)).alias("third"), codecs.occurrence(F.col("q"), F.lit(99)).alias("held"))


@query(f"SELECT l_orderkey, list_position(list_transform(q, lambda x: x > 25), TRUE)::BIGINT AS at FROM ({_TAB})")
def search_serial(read) -> DataFrame:
    """SEARCH: the first element for which the arm holds; at end, none."""
    at = F.array_position(F.transform("q", lambda x: x > 25), F.lit(True))
    return _table(read).select("l_orderkey", F.when(at > 0, at).alias("at"))


@query(f"SELECT l_orderkey, list_contains(q, 10.0) AS found, len(list_filter(q, lambda x: x < 10))::BIGINT AS below FROM ({_TAB})")
def search_all(read) -> DataFrame:
    """SEARCH ALL on an ascending key."""
    return _table(read).withColumn("s", F.array_sort("q")).select("l_orderkey", F.array_contains("s", 10.0).alias("found"), long(F.size(F.filter("s", lambda x: x < 10)), "below"))


@query("SELECT i::BIGINT AS i, (i // 12)::BIGINT AS a, ((i // 4) % 3)::BIGINT AS b, (i % 4)::BIGINT AS c FROM range(24) t(i)")
def occurrence_index(read) -> DataFrame:
    """Subscripts of the n-th element of a 2 x 3 x 4 table; the innermost runs fastest."""
    d = read("region").sparkSession.range(24).withColumnRenamed("id", "i")
    return d.select("i", F.expr("i div 12").alias("a"), (F.expr("i div 4") % 3).alias("b"), (F.col("i") % 4).alias("c"))


@query("SELECT p_partkey, substr(p_name, 1, 2) || 'ZZZ' || substr(p_name, 6) AS spliced FROM part WHERE length(p_name) >= 5")
def splice(read) -> DataFrame:
    return read("part").filter(F.length("p_name") >= 5).select("p_partkey", F.overlay("p_name", F.lit("ZZZ"), 3, 3).alias("spliced"))
