"""Structure of large flow graphs: strongly connected components, reach over their condensation, dominators.

Graphs are edge tables (caller, callee) of any size. Each question is a loop of joins whose
rounds are written to the shared folder; nothing but counts comes to the driver, and no table
of all pairs of nodes is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardwalk.operators.graph import entered, levels
from guardwalk.session import Rounds, numbered

WORD = 63  # bits of a long that stay clear of its sign


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): components by the least of their nodes, by forward-backward colouring.

    Nodes without a way in or without a way out are peeled off, a layer a round: each is a
    component of its own. Of what is left, every node takes the greatest node that reaches it
    as its colour; what reaches a colour's own node within the colour is its component. Edges
    between colours go, and the rest starts again. Rounds are bounded by the longest way that
    peeling follows and by the diameter of the components.
    """
    r = Rounds(edges.sparkSession)
    cut = r.cut
    every = cut(edges.select(F.col("caller").alias("u"), F.col("callee").alias("v")))
    nodes = cut(every.select("u").union(every.select("v")).distinct().withColumnRenamed("u", "node"))
    found: list[DataFrame] = []
    e = every.filter("u <> v")
    while True:
        n = e.count()
        while n:  # what nothing leads to goes before what leads nowhere is looked for, so that the whole table is joined once only
            led = cut(e.join(cut(e.select(F.col("v").alias("u")).distinct()), "u", "left_semi").select("u", "v"))
            e = cut(led.join(cut(led.select(F.col("u").alias("v")).distinct()), "v", "left_semi").select("u", "v").distinct())
            n, before = e.count(), n
            if n == before:
                break
        if not n:
            break
        colour = cut(e.select(F.col("u").alias("x")).distinct().withColumn("c", F.col("x")).withColumn("moved", F.lit(True)))
        while True:  # only nodes whose colour has changed tell their successors
            told = e.join(colour.filter("moved").select(F.col("x").alias("u"), F.col("c").alias("new")), "u").groupBy(F.col("v").alias("x")).agg(F.max("new").alias("new"))
            colour = cut(colour.join(told, "x", "left").select("x", F.greatest("c", F.coalesce("new", "c")).alias("c"), (F.coalesce("new", "c") > F.col("c")).alias("moved")))
            if colour.filter("moved").isEmpty():
                break
        hue = colour.select("x", "c")
        same = cut(e.join(hue.withColumnRenamed("x", "u"), "u").join(hue.select(F.col("x").alias("v"), F.col("c").alias("cv")), "v").filter("c = cv").select("u", "v", "c"))
        front = cut(hue.filter("x = c"))
        inside = [front]
        seen = front
        while True:
            back = same.join(front.select(F.col("x").alias("v")), "v").select(F.col("u").alias("x"), "c").distinct().join(seen.select("x"), "x", "left_anti")
            front = cut(back)
            if front.isEmpty():
                break
            inside.append(front)
            seen = reduce(DataFrame.union, inside)
        found.append(seen)
        done = seen.select("x")
        e = cut(same.join(done.withColumnRenamed("x", "u"), "u", "left_anti").join(done.withColumnRenamed("x", "v"), "v", "left_anti").select("u", "v"))
    if not found:
        return r.last(nodes.withColumn("component", F.col("node")))
    members = reduce(DataFrame.union, found)
    named = members.join(members.groupBy("c").agg(F.min("x").alias("component")), "c").select(F.col("x").alias("node"), "component")
    return r.last(nodes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")))


def reach_bits(edges: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, word, bits), (op, number)): operations that every node reaches, its own among them, as bits of words.

    Nodes that nothing leads to are set aside with their edges, a layer a round, as long as a layer takes half of what is left. The
    rest is one pass over its condensation, from what reaches nothing upwards: a component's words are
    those of its own operations and of its successors, all of which are done before it. Then each
    layer asks its successors once. Only words with a bit are rows.
    """
    r = Rounds(edges.sparkSession)
    cut = r.cut
    names = cut(numbered(ops.select("op").distinct(), ["op"], r))
    word, bit = F.floor(F.col("number") / WORD).cast("int"), F.expr(f"shiftleft(1L, CAST(number % {WORD} AS INT))")
    named = ops.select(F.col("paragraph").alias("node"), "op").distinct().join(names, "op")
    own = cut(named.groupBy("node", word.alias("word")).agg(F.bit_or(bit).alias("bits")))
    e = cut(edges.select(F.col("caller").alias("u"), F.col("callee").alias("v")).filter("u <> v"))
    n = e.count()
    layers: list[DataFrame] = []
    while n:
        led = cut(e.select(F.col("v").alias("u")).distinct().withColumn("led", F.lit(True)))
        split = cut(e.join(led, "u", "left"))
        m = split.filter("led").count()
        if 2 * m > n:
            break
        layers.append(split.filter("led IS NULL").select("u", "v"))
        e, n = split.filter("led").select("u", "v"), m
    values = own.union(_within(e, own, r)) if n else own
    for layer in reversed(layers):
        told = layer.join(values.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        values = values.union(cut(told))
    names = names.checkpoint()
    return r.last(values.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))), names


def _within(edges: DataFrame, own: DataFrame, r: Rounds) -> DataFrame:
    """(node, word, bits) of the nodes of edges (u, v), by a pass over their condensation; own: (node, word, bits) of any nodes."""
    cut = r.cut
    edges = cut(edges.distinct())
    parts = strong_components(edges.select(F.col("u").alias("caller"), F.col("v").alias("callee")))
    of = lambda a, b: parts.select(F.col("node").alias(a), F.col("component").alias(b))
    own = cut(own.join(of("node", "c"), "node").groupBy("c", "word").agg(F.bit_or("bits").alias("bits")))
    down = cut(edges.join(of("u", "cu"), "u").join(of("v", "cv"), "v").filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
    left, open_ = cut(parts.select(F.col("component").alias("c")).distinct()), down
    done: list[DataFrame] = []
    while True:
        ready = cut(left.join(open_.select(F.col("u").alias("c")), "c", "left_anti"))
        if ready.isEmpty():
            break
        words = own.join(ready, "c")
        if done:
            below = reduce(DataFrame.union, done).withColumnRenamed("c", "v")
            words = words.union(down.join(ready.withColumnRenamed("c", "u"), "u").join(below, "v").select(F.col("u").alias("c"), "word", "bits"))
        done.append(cut(words.groupBy("c", "word").agg(F.bit_or("bits").alias("bits"))))
        left = cut(left.join(ready, "c", "left_anti"))
        open_ = cut(open_.join(ready.withColumnRenamed("c", "v"), "v", "left_anti").select("u", "v"))
    whole = reduce(DataFrame.union, done)
    return cut(parts.join(whole, F.col("component") == F.col("c")).select("node", "word", "bits"))


def reach(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """(paragraph, op): operations that a paragraph reaches, its own and its callees'."""
    bits, names = reach_bits(edges, ops)
    at = F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), i -> (shiftright(bits, i) & 1L) = 1L)"))
    numbers = bits.select(F.col("node").alias("paragraph"), "word", at.alias("at")).select("paragraph", (F.col("word").cast("long") * WORD + F.col("at")).alias("number"))
    return numbers.join(names, "number").select("paragraph", "op")


def reach_counts(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """(paragraph, n_ops) of paragraphs that reach any, counted in the words without listing operations."""
    return reach_bits(edges, ops)[0].groupBy(F.col("node").alias("paragraph")).agg(F.sum(F.bit_count("bits")).cast("long").alias("n_ops"))


_NONE = "CAST(array() AS array<string>)"


def _shared(told: DataFrame, own: DataFrame) -> DataFrame:
    """(node, met): of rows (callee, met) the labels in all that aren't null, with the node's own; null if all are."""
    most = told.groupBy("callee").agg(F.count("met").alias("n"))
    each = told.select("callee", F.explode("met").alias("l")).groupBy("callee", "l").agg(F.count("*").alias("n"))
    shared = each.join(most, ["callee", "n"]).groupBy("callee").agg(F.collect_list("l").alias("l"))
    out = most.join(shared, "callee", "left").withColumnRenamed("callee", "node").join(own, "node", "left")
    none = F.expr(_NONE)
    return out.select("node", F.when(F.col("n") > 0, F.array_sort(F.array_union(F.coalesce("l", none), F.coalesce("own", none)))).alias("met"))


def must_pass(edges: DataFrame, entry: str, labels: DataFrame) -> DataFrame:
    """(node, labels): of every node that the entry reaches, the labels that every way to it meets, those of the node itself among them.

    edges: (caller, callee), and `via`, an array of labels that the edge itself meets, if there is such a column; labels: (node, label), any
    number a node. What all ways to a node have met is what all its predecessors tell. First the nodes whose predecessors are all done, a layer
    a round: each is made once, and a round passes only over edges to nodes that aren't done. What circles leave starts with what the first ways found have met
    and only shrinks; nodes whose predecessors have changed are looked at again until none does. Ways
    aren't listed, however many there are.
    """
    r = Rounds(edges.sparkSession)
    cut = r.cut
    none = F.expr(_NONE)
    via = F.col("via") if "via" in edges.columns else none.alias("via")
    every = cut(edges.select("caller", "callee", via).filter(F.col("callee") != entry).distinct())
    own = cut(labels.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("own")))
    start = edges.sparkSession.createDataFrame([(entry,)], "node string").join(own, "node", "left")
    frontier = cut(start.select("node", F.coalesce("own", none).alias("met")))
    callees = every.select(F.col("callee").alias("node")).distinct()
    lone = cut(every.select(F.col("caller").alias("node")).filter(F.col("node") != entry).distinct().join(callees, "node", "left_anti").withColumn("met", F.lit(None).cast("array<string>")))  # nothing reaches them
    done, rest, waiting = [frontier], every, None
    while True:
        split = cut(rest.join(frontier.select(F.col("node").alias("caller"), "met", F.lit(True).alias("told")), "caller", "left"))
        rest = split.filter("told IS NULL").select("caller", "callee", "via")
        now = split.filter("told").select("callee", F.array_union("met", "via").alias("met"))
        waiting = now if waiting is None else waiting.union(now)
        blocked = cut(rest.select("callee").distinct())
        frontier = cut(_shared(waiting.join(blocked, "callee", "left_anti"), own))
        frontier = frontier.union(lone) if len(done) == 1 else frontier
        if frontier.isEmpty():
            break
        done.append(frontier)
        waiting = cut(waiting.join(blocked, "callee", "left_semi"))
    fixed = reduce(DataFrame.union, done).filter("met IS NOT NULL")
    if blocked.isEmpty():
        return r.last(fixed.select("node", F.col("met").alias("labels")))
    e = cut(every.join(blocked, "callee", "left_semi"))
    sets = cut(fixed.join(e.select(F.col("caller").alias("node")).distinct(), "node", "left_semi").withColumn("moved", F.lit(True)))
    while True:
        look = e.join(sets.filter("moved").select(F.col("node").alias("caller")), "caller", "left_semi").select("callee").distinct()
        known = e.join(look, "callee", "left_semi").join(sets.select(F.col("node").alias("caller"), "met"), "caller")
        fresh = _shared(known.select("callee", F.array_union("met", "via").alias("met")), own).withColumnRenamed("met", "new")
        both = sets.join(fresh, "node", "full_outer")
        new = F.coalesce("new", "met")
        sets = cut(both.select("node", new.alias("met"), F.coalesce(~new.eqNullSafe(F.col("met")), F.lit(True)).alias("moved")))
        if sets.filter("moved").isEmpty():
            break
    rounds = sets.join(blocked.withColumnRenamed("callee", "node"), "node", "left_semi").select("node", "met")
    return r.last(fixed.union(rounds).select("node", F.col("met").alias("labels")))


def dominators(edges: DataFrame, entry: str) -> DataFrame:
    """(node, idom, depth, path): the immediate dominator of every node that the entry reaches, and all of them from the entry down.

    What the entry doesn't reach goes first: no round passes over it.
    """
    r = Rounds(edges.sparkSession)
    pairs = entered(edges, entry, r)
    reached = r.cut(levels(pairs, entry, r).select(F.col("paragraph").alias("node")))
    inner = r.cut(pairs.join(reached.withColumnRenamed("node", "caller"), "caller", "left_semi"))
    sets = must_pass(inner, entry, reached.withColumn("label", F.col("node")))
    ranks = sets.select(F.col("node").alias("d"), F.size("labels").alias("rank"))  # dominators of a node have sets of different sizes, in their order
    each = sets.select("node", F.explode("labels").alias("d")).join(ranks, "d")
    paths = each.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda x: x["d"]).alias("path"))
    depth = F.size("path") - 1
    return paths.select("node", F.when(depth > 0, F.element_at("path", depth)).alias("idom"), depth.alias("depth"), "path")
