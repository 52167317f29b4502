"""Structure of flow graphs, against plain Python."""

import random

import pytest

from guardwalk.operators import flow, graph, paths


def reached(edges, start, gone=None):
    seen, open_ = set(), [start] if start != gone else []
    while open_:
        x = open_.pop()
        if x not in seen:
            seen.add(x)
            open_ += [b for a, b in edges if a == x and b != gone]
    return seen


def random_edges(seed, n, m):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}") for _ in range(m)})


@pytest.mark.parametrize("seed", [0, 1])
def test_components_and_reach(spark, seed):
    edges = random_edges(seed, 24, 32)
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    to = {n: reached(edges, n) for n in nodes}
    ops = [(n, f"op{i % 70:02d}") for i, n in enumerate(nodes * 5)] if seed else [(nodes[0], "a"), (nodes[-2], "b"), ("alone", "c")]
    e = spark.createDataFrame(edges, "caller string, callee string")
    o = spark.createDataFrame(ops, "paragraph string, op string")
    assert {r["node"]: r["component"] for r in flow.strong_components(e).collect()} == {n: min(m for m in to[n] if n in to[m]) for n in nodes if n != "alone"}
    want = {(n, op) for n in nodes for p, op in ops if p in to[n]}
    assert {tuple(r) for r in flow.reach(e, o).collect()} == want
    assert {r["paragraph"]: r["n_ops"] for r in flow.reach_counts(e, o).collect()} == {n: sum(a == n for a, _ in want) for n in {a for a, _ in want}}


def test_one_large_circle(spark):
    """All nodes in one component, found although every way round is long."""
    edges = [(f"n{i:02d}", f"n{(i + 1) % 12:02d}") for i in range(12)] + [("in", "n05"), ("n07", "out")]
    got = {r["node"]: r["component"] for r in flow.strong_components(spark.createDataFrame(edges, "caller string, callee string")).collect()}
    assert got == {"in": "in", "out": "out"} | {f"n{i:02d}": "n00" for i in range(12)}


@pytest.mark.parametrize("seed", [0, 3])
def test_dominators(spark, seed):
    edges = random_edges(seed, 12, 22)
    entry = edges[0][0]
    all_ = reached(edges, entry)
    doms = {v: {d for d in all_ if d in (v, entry) or v not in reached(edges, entry, d)} for v in all_}
    got = {r["node"]: r for r in flow.dominators(spark.createDataFrame(edges, "caller string, callee string"), entry).collect()}
    assert {v: set(r["path"]) for v, r in got.items()} == doms
    assert all(r["depth"] == len(doms[v]) - 1 and (r["idom"] is None) == (v == entry) and (v == entry or len(doms[r["idom"]]) == r["depth"]) for v, r in got.items())


STATEMENTS = "program string, paragraph string, ordinal int, kind string, text string, guards array<string>"


def test_a_ladder_of_diamonds_ends(spark):
    """Forty levels with two ways each: 2^40 ways to the end, one guard that all of them meet."""
    rows = [x for i in range(40) for x in (("p", f"L{i:02d}", 1, "PERFORM", f"L{i + 1:02d}", [f"G{i}"]), ("p", f"L{i:02d}", 2, "PERFORM", f"L{i + 1:02d}", [f"NOT ( G{i} )"]))]
    rows.append(("p", "L40", 1, "GOBACK", "", ["LAST"]))
    rows += [("p", "MAIN", 1, "PERFORM", "L00", []), ("p", "MAIN", 2, "PERFORM", "AFTER", []), ("p", "AFTER", 1, "MOVE", "", [])]
    s = spark.createDataFrame(rows, STATEMENTS)
    got = {(r["paragraph"], r["ordinal"]): (r["guards"], r["sure"]) for r in paths.ways_to_end(s).collect()}
    assert len(got) == 82 and got["MAIN", 1] == (["LAST"], False) and got["L40", 1] == (["LAST"], True) and got["L39", 1] == (["G39", "LAST"], True) and got["L38", 2] == (["NOT ( G38 )", "LAST"], False)


def test_survival_where_ways_differ(spark):
    """Two ways with nothing in common can't be denied by one condition; a callee that always ends the run makes what follows unreachable."""
    rows = [
        ("p", "A", 1, "PERFORM", "B", []), ("p", "A", 2, "PERFORM", "X", []), ("p", "A", 3, "PERFORM", "D", ["K"]), ("p", "A", 4, "PERFORM", "X", ["K"]), ("p", "A", 5, "PERFORM", "X", []),
        ("p", "B", 1, "STOP", "RUN", ["P"]), ("p", "B", 2, "STOP", "RUN", ["Q"]), ("p", "D", 1, "GOBACK", "", []), ("p", "X", 1, "MOVE", "", []),
    ]
    got = {r["ordinal"]: (r["obligations"], r["infeasible"], r["undecided"]) for r in paths.survival(spark.createDataFrame(rows, STATEMENTS)).collect() if r["paragraph"] == "A"}
    assert got == {1: ([], False, False), 2: ([], False, True), 3: ([], False, True), 4: ([], True, True), 5: (["NOT ( K )"], False, True)}


def test_producers_follow_long_chains(spark):
    moves = [(f"F{i}", f"F{i + 1}", "field") for i in range(20)] + [("F20", "7", "literal")]
    got = graph.producers(spark.createDataFrame(moves, "field string, source string, source_kind string"), spark.createDataFrame([("F0",)], "field string")).collect()
    assert [tuple(r) for r in got] == [("F0", "7", "literal", 20)]


def test_empty_graph(spark):
    e = spark.createDataFrame([], "caller string, callee string")
    assert flow.strong_components(e).count() == 0 and flow.reach(e, spark.createDataFrame([], "paragraph string, op string")).count() == 0
    assert [r["node"] for r in flow.dominators(spark.createDataFrame([("a", "b")], "caller string, callee string"), "z").collect()] in ([], ["z"])


def test_depths_make_their_edges_once(spark):
    """A round reads the edges, it doesn't make them again from what they are derived from."""
    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "caller string, callee string").mapInArrow(told, "caller string, callee string")
    assert {tuple(r) for r in graph.depths(e, "n0").collect()} == {(f"n{i}", i) for i in range(6)}
    assert made.value == 5


def test_unreached_edges_go_before_the_rounds(spark, monkeypatch):
    seen = []
    real = flow.must_pass
    monkeypatch.setattr(flow, "must_pass", lambda edges, entry, labels: seen.append((edges.count(), labels.count())) or real(edges, entry, labels))
    e = spark.createDataFrame([("a", "b"), ("b", "c")] + [(f"x{i}", "b") for i in range(30)], "caller string, callee string")
    assert sorted((r["node"], r["idom"]) for r in flow.dominators(e, "a").collect()) == [("a", None), ("b", "a"), ("c", "b")]
    assert seen == [(2, 3)]


def test_layers_that_nothing_leads_to_stay_out_of_the_condensation(spark, monkeypatch):
    seen = []
    real = flow.strong_components
    monkeypatch.setattr(flow, "strong_components", lambda edges: seen.append(edges.count()) or real(edges))
    outer = [(f"x{i}", f"y{i % 4}") for i in range(40)] + [(f"y{i}", "a") for i in range(4)]
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), *outer], "caller string, callee string")
    o = spark.createDataFrame([("c", "p"), ("y1", "q"), ("x0", "r"), ("lone", "s")], "paragraph string, op string")
    want = {(n, "p") for n in ["a", "b", "c", *{x for pair in outer for x in pair}]} | {(n, "q") for n in ["y1", *[f"x{i}" for i in range(1, 40, 4)]]} | {("x0", "r"), ("lone", "s")}
    assert {tuple(r) for r in flow.reach(e, o).collect()} == want
    assert seen == [3]


def test_must_pass_with_labels_of_edges(spark):
    """Layers, a circle behind them, nodes that the entry doesn't reach; edges have labels too."""
    edges = [("s", "a", ["x", "y"]), ("s", "b", ["y"]), ("a", "c", []), ("b", "c", []), ("c", "d", ["z"]), ("d", "e", []), ("e", "c2", []), ("c2", "d2", []), ("d2", "c2", ["w"]), ("d2", "f", []), ("u", "a", []), ("u", "v", []), ("f", "s", ["q"]), ("k", "l", []), ("l", "k", []), ("l", "c2", [])]
    own = {"a": {"A"}, "b": {"A"}, "d2": {"D"}, "u": {"U"}}
    met = {"s": set()}
    while True:  # the greatest fixpoint over what is reached
        new = {"s": set()}
        for v in {v for u, v, _ in edges if u in met and v != "s"}:
            new[v] = set.intersection(*[met[u] | set(via) for u, w, via in edges if w == v and u in met]) | own.get(v, set())
        if new == met:
            break
        met = new
    labels = spark.createDataFrame([(n, x) for n, some in own.items() for x in some], "node string, label string")
    out = flow.must_pass(spark.createDataFrame(edges, "caller string, callee string, via array<string>"), "s", labels)
    assert {r["node"]: set(r["labels"]) for r in out.collect()} == met
