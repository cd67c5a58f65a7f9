"""Components, levels and choices against plain searches."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lautwerk import workload
from lautwerk.operators import graph, order

REL = "graph int, name string, src string, ordinal int, tgt string"


def relation(spark, edges, name="contains"):
    return spark.createDataFrame([(g, name, a, 0, b) for g, a, b in edges], REL)


def reach(edges, a):
    seen, todo = set(), [a]
    while todo:
        for x, y in edges:
            if x == todo[-1] and y not in seen:
                seen.add(y)
                todo.insert(0, y)
        todo.pop()
    return seen


def test_components_of_random_graphs(spark):
    draw = random.Random(3)
    edges = []
    for g in range(6):
        n = 14
        edges += [(g, f"v{draw.randrange(n)}", f"v{draw.randrange(n)}") for _ in range(draw.randrange(8, 26))]
    got = {(r["graph"], r["node"]): r["component"] for r in order.strong_components(relation(spark, edges)).collect()}
    want = {}
    for g in range(6):
        own = {(a, b) for k, a, b in edges if k == g}
        to = {a: reach(own, a) for a in {x for e in own for x in e}}
        for a in to:
            if a in to[a]:
                want[g, a] = min(b for b in to if b in to[a] and a in to[b])
    assert got == want


def test_long_rings_and_chains(spark):
    n = 600
    edges = [(1, f"r{k}", f"r{(k + 1) % n}") for k in range(n)] + [(1, f"c{k}", f"c{k + 1}") for k in range(n)] + [(1, "r5", "c0"), (2, "x", "x"), (2, "x", "y")]
    got = {(r["graph"], r["node"], r["component"]) for r in order.strong_components(relation(spark, edges)).collect()}
    assert got == {(1, f"r{k}", "r0") for k in range(n)} | {(2, "x", "x")}


def test_levels_and_order(spark):
    edges = [(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "d", "c"), (1, "c", "e"), (2, "x", "y"), (2, "y", "x"), (2, "y", "z")]
    df = spark.createDataFrame(edges, "graph int, src string, tgt string")
    assert {(r["graph"], r["node"]): r["level"] for r in order.levels(df).collect()} == {(1, "a"): 0, (1, "d"): 0, (1, "b"): 1, (1, "c"): 2, (1, "e"): 3, (2, "x"): None, (2, "y"): None, (2, "z"): None}
    clock = spark.createDataFrame([(1, "a", 9), (1, "b", 0), (1, "c", 0), (1, "d", 3), (1, "e", 1), (1, "lone", 5), (2, "x", 0)], "graph int, node string, clock int")
    places = {(r["graph"], r["node"]): r["place"] for r in order.scan_order(df, clock).collect()}
    assert places == {(1, "d"): 0, (1, "lone"): 1, (1, "a"): 2, (1, "b"): 3, (1, "c"): 4, (1, "e"): 5, (2, "x"): None}


def test_small_graphs_are_taken_whole(spark, monkeypatch):
    draw = random.Random(11)
    edges = [(f"g{g}", draw.randrange(9), draw.randrange(9)) for g in range(60) for _ in range(draw.randrange(1, 14))]
    edges += [("deep", k, k + 1) for k in range(300)] + [("deep", 0, 300)]
    df = spark.createDataFrame(edges + edges[:9], "graph string, src long, tgt long")
    own = lambda d: {(r["graph"], r["node"]): r["level"] for r in d.collect()}
    rounds = order._levels_by_rounds
    monkeypatch.setattr(order, "_levels_by_rounds", None)
    whole = own(order.levels(df))
    assert whole["deep", 300] == 300 and None in whole.values()
    monkeypatch.setattr(order, "_levels_by_rounds", rounds)
    monkeypatch.setattr(order, "SMALL", 6)
    few = [e for e in edges if e[0] != "deep"]
    assert own(order.levels(spark.createDataFrame(few, "graph string, src long, tgt long"))) == {k: v for k, v in whole.items() if k[0] != "deep"}


def test_graphs_across_chunks(monkeypatch):
    monkeypatch.setattr(order, "CHUNK", 7)
    graphs = [g for g in range(20) for _ in range(g % 5 + 1)]
    t = pa.table({"graph": graphs, "src": list(range(len(graphs))), "tgt": [0] * len(graphs)})
    got = list(order.whole_graphs(t.to_batches(max_chunksize=4)))
    assert pa.concat_tables(got).equals(t) and len(got) > 3
    assert sum(len(set(x["graph"].to_pylist())) for x in got) == 20


def test_lines_without_a_day_stand_last(spark, tmp_path):
    rows = [(1, 1, "2020-01-02"), (1, 2, None), (1, 3, "2020-01-01"), (1, 3, "2020-02-01"), (2, 1, None), (3, 1, "2020-01-01"), (3, 2, "2020-01-01")]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, day string").select("l_orderkey", "l_linenumber", F.col("day").cast("date").alias("l_shipdate"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["l_orderkey"], r["l_linenumber"]): (r["level"], r["place"]) for r in workload.queries()["line_precedence"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3): (0, 0), (1, 1): (1, 1), (1, 2): (2, 2), (2, 1): (0, 0), (3, 1): (0, 0), (3, 2): (0, 1)}


def test_choices(spark):
    picks = [(1, f"p{k}", f"p{k + 1}") for k in range(40)] + [(1, "a", "b"), (1, "b", "a"), (1, "q", "nowhere"), (2, "s", "s")]
    nodes = spark.createDataFrame([(1, f"p{k}") for k in range(41)] + [(1, x) for x in "abq"] + [(2, "s"), (1, "free")], "graph int, node string")
    starts = spark.createDataFrame([(1, "p0"), (1, "p39"), (1, "a"), (1, "q"), (1, "free"), (2, "s")], "graph int, node string")
    got = {(r["graph"], r["node"]): (r["resolved"], r["steps"], r["reason"]) for r in order.resolve(relation(spark, picks, "selects"), starts, nodes).collect()}
    assert got == {(1, "p0"): ("p40", 40, "resolved"), (1, "p39"): ("p40", 1, "resolved"), (1, "a"): (None, None, "cycle"), (1, "q"): (None, 1, "dangling"), (1, "free"): ("free", 0, "resolved"), (2, "s"): (None, None, "cycle")}
    links = [(1, "alternatives", "a", 0, "x", 1), (1, "alternatives", "a", 1, "x", 1), (1, "alternatives", "b", 0, "x", 1), (1, "alternatives", "b", 0, "y", 2), (1, "selects", "c", 0, "x", 1), (1, "alternatives", "d", 0, "x", 1), (1, "selects", "d", 0, "y", 1), (1, "alternatives", "e", 0, "x", 1), (1, "selects", "e", 0, "x", 1)]
    bad = {(r["node"], r["reason"]) for r in order.check_choices(spark.createDataFrame(links, REL + ", link int")).collect()}
    assert bad == {("a", "choice candidates must be distinct"), ("b", "choice event owns at most one alternatives relation"), ("c", "selection source owns no alternatives relation"), ("d", "selection is not a member of alternatives")}


def test_graphs_without_edges(spark):
    none = relation(spark, [])
    assert order.strong_components(none).count() == 0 and graph.cycles(none).count() == 0
    assert order.levels(spark.createDataFrame([], "graph int, src string, tgt string")).count() == 0
