"""Questions about ways through a program: frames, chains through waypoints, missing frames, survival, obligations.

Inputs are the tables of `sources.program`; a program's statements are few rows, but many
programs may be asked at once, so every step is a join keyed by program and paragraph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardwalk.operators import flow
from guardwalk.operators.graph import depths, shortest_chains
from guardwalk.session import Rounds


def frames(chains: DataFrame, limit: int = 25) -> DataFrame:
    """(rank, paragraph, depth, n_guards): the most guarded, then the deepest, then by name; the report has `limit` rows."""
    order = [F.desc("n_guards"), F.desc("depth"), F.col("paragraph")]
    top = chains.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "paragraph", "depth", "n_guards")


def positions(chains: DataFrame) -> DataFrame:
    """(target, pos, frame): every frame of every chain with its place from 0."""
    return chains.select(F.col("paragraph").alias("target"), F.posexplode("chain").alias("pos", "frame"))


def on_chain(entered: Column, chain: Column) -> tuple[Column, Column, Column]:
    """(frames of the chain that a run entered, the place of the first it didn't, that frame); the last two are null for a run that entered all."""
    lacking = F.array_except(chain, entered)  # keeps the chain's order
    frame = F.get(lacking, F.lit(0))
    return F.size(F.array_intersect(entered, chain)), F.nullif((F.array_position(chain, frame) - 1).cast("int"), F.lit(-1)), frame


def chain_via(edges: DataFrame, stops: list[str]) -> DataFrame:
    """(depth, chain): the shortest chain through all stops in turn; no row if a leg doesn't exist."""
    legs = []
    for a, b in zip(stops, stops[1:], strict=False):
        leg = shortest_chains(edges, a).filter(F.col("paragraph") == b)
        legs.append(leg.select(F.slice("chain", 2, F.size("chain")).alias(f"leg{len(legs)}")))
    whole = reduce(lambda x, y: x.join(y, F.lit(True)), legs)  # one row at most a leg
    chain = F.concat(F.array(F.lit(stops[0])), *[F.col(f"leg{i}") for i in range(len(legs))])
    return whole.select((F.size(chain) - 1).alias("depth"), chain.alias("chain"))


END = "#end"


def ways_to_end(statements: DataFrame) -> DataFrame:
    """(program, paragraph, ordinal, guards, sure): statements at which a run may end, and what must hold for it.

    A PERFORM of a paragraph that may end the run is one. Guards are the statement's own, then, sorted,
    those that every way from its callee to an end meets, in the graph that leads from the end back
    to callers. `sure`: the run does end there if the guards hold, as the callee always ends it
    or has one way to do so; otherwise they are necessary, not sufficient. Ways aren't listed, so
    their number doesn't matter. A recursion adds nothing.
    """
    name = lambda *c: F.concat_ws("\x1f", *c)
    calls = F.upper(F.element_at(F.split("text", " "), 1))
    ends = F.col("kind").isin("GOBACK", "STOP") | (F.col("kind") == "EXIT") & (F.col("text") == "PROGRAM")
    s = statements.filter(ends | (F.col("kind") == "PERFORM")).select(
        "program", "paragraph", "ordinal", "guards", ends.alias("own"), name("program", "paragraph").alias("here"), name("program", "paragraph", F.col("ordinal").cast("string")).alias("at"), F.when(ends, F.lit(END)).otherwise(name("program", calls)).alias("below")
    )
    r = Rounds(statements.sparkSession)
    s = r.cut(s)
    tagged = F.transform("guards", lambda g: F.concat(F.lit("g"), g))
    # of the statements of a paragraph that lead to one callee, or to the end, a way meets what all of them have
    all_have = lambda lists: F.aggregate(F.slice(lists, 2, F.size(lists)), F.get(lists, F.lit(0)), F.array_intersect)
    back = s.groupBy(F.col("below").alias("caller"), F.col("here").alias("callee")).agg(all_have(F.collect_set(tagged)).alias("via"))
    met = flow.must_pass(back, END, s.select(F.col("here").alias("node"), F.concat(F.lit("p"), "here").alias("label")).distinct())
    bare = s.filter(F.size("guards") == 0).select(F.col("below").alias("caller"), F.col("here").alias("callee")).distinct()
    always = depths(bare, END).select(F.col("paragraph").alias("below"), F.lit(True).alias("always"))
    own_tag = F.concat(F.lit("p"), "here")
    below = s.filter(~F.col("own")).join(met.withColumnRenamed("node", "below"), "below").withColumn("labels", F.array_union(tagged, F.col("labels")))
    may = r.cut(s.filter("own").withColumn("labels", tagged).unionByName(below).filter(~F.array_contains("labels", own_tag)))  # may end, and not by recursion
    lone = may.groupBy("here").agg(F.count("*").alias("n")).filter("n = 1").select("here")
    several = may.select("at", F.explode("labels").alias("l")).filter("l LIKE 'p%'").join(lone.select(F.concat(F.lit("p"), "here").alias("l")), "l", "left_anti").select("at").distinct().withColumn("several", F.lit(True))
    out = may.join(several, "at", "left").join(always, "below", "left")
    every = F.transform(F.filter("labels", lambda x: x.startswith("g")), lambda x: F.substr(x, F.lit(2)))
    all_ = F.concat("guards", F.array_sort(F.array_except(every, F.col("guards"))))
    sure = F.col("own") | F.coalesce("always", F.lit(False)) | F.col("several").isNull()
    return r.last(out.select("program", "paragraph", "ordinal", all_.alias("guards"), sure.alias("sure")))


def survival(statements: DataFrame) -> DataFrame:
    """(program, paragraph, ordinal, callee, obligations, infeasible, undecided) of every PERFORM and GO TO.

    An earlier statement of the paragraph that may end the run must not have ended it: the guards on
    every way to that end mustn't hold together, without those that the call has too. One that
    surely ends the run under guards that the call shares, or under none, makes the call infeasible; if it
    needn't end it (its ways have nothing in common that could be denied) the call is undecided. One that
    is on the other side of a condition obliges to nothing.
    """
    word = F.when(F.col("kind") == "GO", F.regexp_extract("text", r"(?i)^TO\s+(\S+)", 1)).otherwise(F.element_at(F.split("text", " "), 1))
    calls = statements.filter("kind IN ('PERFORM', 'GO')").select("program", "paragraph", "ordinal", F.upper(word).alias("callee"), F.col("guards").alias("held"))
    ends = ways_to_end(statements).select("program", "paragraph", F.col("ordinal").alias("before"), "guards", "sure")
    j = calls.join(ends, ["program", "paragraph"], "left").withColumn("earlier", F.coalesce(F.col("before") < F.col("ordinal"), F.lit(False)))
    no = lambda g: F.concat(F.lit("NOT ( "), g, F.lit(" )"))
    apart = F.exists("guards", lambda g: F.array_contains("held", no(g))) | F.exists("held", lambda h: F.array_contains("guards", no(h)))
    rest = F.array_except("guards", "held")
    owed = F.when(F.col("earlier") & ~apart & (F.size(rest) > 0), no(F.array_join(rest, " AND ")))
    met = F.coalesce(F.col("earlier") & ~apart & (F.size(rest) == 0), F.lit(False))
    return j.groupBy("program", "paragraph", "ordinal", "callee").agg(
        F.array_sort(F.collect_set(owed)).alias("obligations"), F.bool_or(met & F.coalesce("sure", F.lit(False))).alias("infeasible"), F.bool_or(met & ~F.coalesce("sure", F.lit(False))).alias("undecided")
    )


def branch_obligations(statements: DataFrame) -> DataFrame:
    """(program, paragraph, ordinal, direction, obligations): what makes each IF go each way."""
    one = statements.filter("kind = 'IF'").select("program", "paragraph", "ordinal", "guards", "text", F.explode(F.array(F.lit(True), F.lit(False))).alias("direction"))
    own = F.when(F.col("direction"), F.col("text")).otherwise(F.concat(F.lit("NOT ( "), "text", F.lit(" )")))
    return one.select("program", "paragraph", "ordinal", "direction", F.concat("guards", F.array(own)).alias("obligations"))


def resume_points(reach: DataFrame) -> DataFrame:
    """(paragraph, n_ops, rank): frames by the number of external operations they reach, the most first."""
    n = reach.groupBy("paragraph").agg(F.count_distinct("op").alias("n_ops"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_ops"), "paragraph")))
