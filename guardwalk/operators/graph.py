"""Call-graph operators over an edge table (caller, callee, seq, guards, kind), as fixpoints of joins.

Every fixpoint is a driver loop over DataFrames: one join of the frontier with the
edges per round, visited rows taken away by an anti join, lineage cut by a
checkpoint. Nothing is collected but the question whether a round found anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardwalk.session import Rounds, checkpoint_dir


def entered(edges: DataFrame, entry: str, r: Rounds) -> DataFrame:
    """(caller, callee) of callers that are the entry or somebody's callee, as a file: others are never reached."""
    pairs = r.cut(edges.select("caller", "callee"))
    led = r.cut(pairs.select(F.col("callee").alias("caller")).filter(F.col("callee") != entry).distinct().union(pairs.sparkSession.createDataFrame([(entry,)], "caller string")))
    return r.cut(pairs.join(led, "caller", "left_semi"))


def levels(pairs: DataFrame, entry: str, r: Rounds) -> DataFrame:
    """(paragraph, depth) over pairs (caller, callee) that are files already; a frontier is a file too, so that Spark sees how small it is and leaves the pairs where they are."""
    frontier, depth = r.cut(pairs.sparkSession.createDataFrame([(entry, 0)], "paragraph string, depth int")), 0
    found = [frontier]
    while True:
        depth += 1
        step = pairs.join(frontier.select("paragraph"), F.col("paragraph") == F.col("caller")).select(F.col("callee").alias("paragraph"), F.lit(depth).alias("depth")).distinct()
        frontier = r.cut(step.join(reduce(DataFrame.union, found).select("paragraph"), "paragraph", "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.union, found)
        found.append(frontier)


def depths(edges: DataFrame, entry: str) -> DataFrame:
    """(paragraph, depth): breadth-first levels from the entry. Edges are made once."""
    r = Rounds(edges.sparkSession)
    return r.last(levels(entered(edges, entry, r), entry, r))


def shortest_chains(edges: DataFrame, entry: str) -> DataFrame:
    """(paragraph, depth, chain, n_guards): the shortest chain to every paragraph; of equal ones that whose edges come first."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    seen = spark.createDataFrame([(entry, 0, [entry], 0, [])], "paragraph string, depth int, chain array<string>, n_guards long, edge_seqs array<long>")
    frontier, depth = seen, 0
    while True:
        depth += 1
        e = edges.select("caller", "callee", F.col("seq").cast("long").alias("seq"), F.coalesce(F.size("guards"), F.lit(0)).cast("long").alias("g"))
        step = frontier.join(e, F.col("paragraph") == F.col("caller")).join(seen.select(F.col("paragraph").alias("callee")), "callee", "left_anti")
        cand = step.select(
            F.col("callee").alias("paragraph"), F.lit(depth).alias("depth"), F.concat("chain", F.array("callee")).alias("chain"),
            (F.col("n_guards") + F.col("g")).alias("n_guards"), F.concat("edge_seqs", F.array("seq")).alias("edge_seqs"),
        )
        best = cand.groupBy("paragraph").agg(F.min_by(F.struct("depth", "chain", "n_guards", "edge_seqs"), F.col("edge_seqs")).alias("b"))
        frontier = best.select("paragraph", "b.*").checkpoint()
        if frontier.isEmpty():
            return seen.drop("edge_seqs")
        seen = seen.union(frontier)


def live_in(edges: DataFrame, uses: DataFrame) -> DataFrame:
    """(paragraph, field): fields read before they are written, through PERFORM.

    uses: (paragraph, pos, kind, field) with kind read, write or call (field is the callee).
    """
    first_write = uses.filter("kind = 'write'").groupBy("paragraph", "field").agg(F.min("pos").alias("w"))
    reads = uses.filter("kind = 'read'").join(first_write, ["paragraph", "field"], "left").filter("w IS NULL OR pos <= w")
    live = reads.select("paragraph", "field").distinct()
    calls = uses.filter("kind = 'call'").select("paragraph", "pos", F.col("field").alias("callee"))
    while True:
        up = calls.join(live.select(F.col("paragraph").alias("callee"), "field"), "callee").join(first_write, ["paragraph", "field"], "left").filter("w IS NULL OR pos <= w")
        fresh = up.select("paragraph", "field").distinct().join(live, ["paragraph", "field"], "left_anti").checkpoint()
        if fresh.isEmpty():
            return live
        live = live.union(fresh)


def reaching_writers(writers: DataFrame, reads: DataFrame) -> DataFrame:
    """The writer that supplies each read: nearest before it in its paragraph, else in the nearest earlier paragraph, else later.

    writers: (field, rank, line, writer); reads: (read_id, field, rank, line).
    """
    w = writers.select("field", F.col("rank").alias("w_rank"), F.col("line").alias("w_line"), "writer")
    j = reads.join(w, "field", "left")
    tier = F.when((F.col("w_rank") == F.col("rank")) & (F.col("w_line") < F.col("line")), 0).when(F.col("w_rank") < F.col("rank"), 1).otherwise(2)
    near = Window.partitionBy("read_id").orderBy(tier, F.when(tier == 2, F.col("w_rank")).otherwise(-F.col("w_rank")), F.when(tier == 2, F.col("w_line")).otherwise(-F.col("w_line")))
    return j.withColumn("n", F.row_number().over(near)).filter("n = 1").select("read_id", "field", "writer")


def producers(moves: DataFrame, targets: DataFrame) -> DataFrame:
    """(field, source, source_kind, hops): MOVE renames are walked back to a literal, stub or input, however long the chain.

    moves: (field, source, source_kind) with source_kind field, literal, stub or input.
    """
    walk = targets.select("field", F.col("field").alias("at"), F.lit(0).alias("hops"), F.array("field").alias("path"))
    done = None
    while True:
        step = walk.join(moves.select(F.col("field").alias("at"), "source", "source_kind"), "at", "left")
        ended = step.filter("source_kind IS NULL OR source_kind <> 'field'").select("field", F.coalesce("source", "at").alias("source"), F.coalesce("source_kind", F.lit("input")).alias("source_kind"), F.col("hops").cast("int").alias("hops"))
        done = ended if done is None else done.union(ended)
        walk = step.filter("source_kind = 'field'").filter(~F.array_contains("path", F.col("source"))).select("field", F.col("source").alias("at"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("source")).alias("path"))
        walk = walk.checkpoint()
        if walk.isEmpty():
            break
    return done.distinct()
