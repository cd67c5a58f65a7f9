"""Components, orders and choices of graphs by pointer doubling.

Pointers that are followed one step a round reach the end of a path of n nodes in n rounds; here every round lets a pointer
skip to where the one it points to points, so it takes about log2(n). Each round is a join, written to the shared folder.
Relations are (graph, name, src, ordinal, tgt).

Most tables hold many small graphs. Those of at most SMALL rows are dealt out whole, and a task takes many of them at once; only
larger ones need joins round by round.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import _cut, children

_KEY = ["graph", "node"]
#: Rows of a graph that a task may hold, and rows and bytes that it takes at once.
SMALL = 10_000
CHUNK, CHUNK_BYTES = 100_000, 32 << 20


def doubled(pointers: DataFrame, combine: Column | None = None) -> DataFrame:
    """(graph, node, to, n, value): pointers (graph, node, to, value) followed to their ends, with the number of steps.

    to is null at an end. A pointer that runs in a circle stops at a step count of at least the number of pointers, so its n is
    that large. combine: of columns value (so far) and next (of what is pointed to), what value becomes; by default the last.
    """
    combine = F.coalesce("next", "value") if combine is None else combine

    def jumped(state: DataFrame) -> DataFrame:
        on = state.select(F.col("graph").alias("g"), F.col("node").alias("m"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("value").alias("next"))
        joined = state.drop("moved").join(on, (F.col("graph") == F.col("g")) & (F.col("to") == F.col("m")), "left")
        # an end that no pointer starts from has nothing to skip to
        to = F.when(F.col("m").isNull() | F.col("to2").isNull(), F.col("to")).otherwise(F.col("to2"))
        return joined.select(*_KEY, to.alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.when(F.col("m").isNull(), F.col("value")).otherwise(combine).alias("value"), F.col("to2").isNotNull().alias("moved"))

    state = _cut(pointers.select(*_KEY, "to", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("n"), "value"))
    limit = state.count()
    for k in itertools.count(0, 2):  # two jumps a round, counted as they are written
        seen = Observation()
        state = _cut(jumped(jumped(state)).observe(seen, F.count(F.when(F.col("moved"), 1)).alias("moved")))
        if (1 << k) > limit or not seen.get["moved"]:
            return state.drop("moved")


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that can't be on a cycle since every way from them, or to them, ends. Ways without a fork are
    followed by doubling, so chains and trees go in a few rounds whatever their depth."""
    left = edges.count()
    while left:
        for src, tgt in (("src", "tgt"), ("tgt", "src")):
            # a node with one way on points along it; one with none is an end; one with several stays
            ways = edges.groupBy("graph", src).agg(F.count("*").alias("k"), F.first(tgt).alias("to")).withColumnRenamed(src, "node")
            nodes = edges.select("graph", F.col(tgt).alias("node")).distinct().join(ways, _KEY, "full")
            if nodes.where("k is null").isEmpty():  # nothing ends in this direction
                continue
            pointer = F.when(F.col("k") == 1, F.col("to"))
            ends = doubled(nodes.select(*_KEY, pointer.alias("to"), F.coalesce(F.col("k") > 1, F.lit(False)).alias("value")))
            size = ends.count()
            dead = ends.where(~F.col("value") & (F.col("n") <= size)).select("graph", F.col("node").alias(src))
            edges = _cut(edges.join(dead, ["graph", src], "left_anti").join(dead.withColumnRenamed(src, tgt), ["graph", tgt], "left_anti").select("graph", "src", "tgt"))
        now = edges.count()
        if now == left:
            break
        left = now
    return edges


def _largest_before(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph, node, label): the largest label among the nodes that reach a node, itself included."""
    color = _cut(labels)
    while True:
        at = color.select("graph", F.col("node").alias("src"), F.col("label").alias("l"))
        best = edges.join(at, ["graph", "src"]).groupBy("graph", "tgt").agg(F.max(F.struct("l", "src")).alias("best")).select("graph", F.col("tgt").alias("node"), "best")
        step = color.join(best, _KEY, "left").select(*_KEY, F.col("label").alias("old"), F.col("best.l").alias("l"), F.col("best.src").alias("from"))
        step = _cut(step)
        if step.where("l > old").isEmpty():
            return color
        pointers = step.select(*_KEY, F.when(F.col("l") >= F.col("old"), F.col("from")).alias("to"), F.greatest("old", F.coalesce("l", "old")).alias("value"))
        color = doubled(pointers, F.greatest("value", "next")).select(*_KEY, F.col("value").alias("label"))


def _rings(edges: DataFrame) -> DataFrame:
    """(graph, node, root) of the nodes of rings that nothing else of peeled edges leads into or out of, followed by doubling once."""
    out = edges.groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("k"), F.first("tgt").alias("to"))
    into = edges.groupBy("graph", F.col("tgt").alias("node")).agg(F.count("*").alias("m"))
    pointers = out.join(into, _KEY, "full").select(*_KEY, F.when((F.col("k") == 1) & (F.col("m") == 1), F.col("to")).alias("to"), F.col("node").alias("value"))
    ends = doubled(pointers, F.least("value", F.coalesce("next", "value")))
    # a way without a fork that isn't a ring has fewer steps than there are nodes; every other one has gone round at least once
    return _cut(ends.where(F.col("n") >= ends.count()).select(*_KEY, F.col("value").alias("root")))


def strong_components(relations: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, node, component): for each node on a cycle the smallest node of its strongly connected component.

    Nodes are coloured by the largest label that reaches them; those that their colour's node is reached from, too, are its
    component. No component has two colours, so what else crosses colours is cut, and labels are drawn anew for the rest.
    """
    edges = _cut(children(relations, name).select("graph", "src", "tgt").distinct())
    loops = edges.where("src = tgt").select("graph", F.col("src").alias("node"), F.col("src").alias("root")).distinct()
    edges = _peeled(_cut(edges.where("src <> tgt")))
    found = None
    if not edges.isEmpty():
        found = _rings(edges)
        edges = _cut(edges.join(found.select("graph", F.col("node").alias("src")), ["graph", "src"], "left_anti").select("graph", "src", "tgt"))
    for turn in itertools.count():
        if edges.isEmpty():
            break
        nodes = edges.select("graph", F.explode(F.array("src", "tgt")).alias("node")).distinct()
        # a label tells nodes apart even where their hashes are equal
        labels = _cut(nodes.select(*_KEY, F.struct(F.xxhash64(F.lit(turn), "graph", "node").alias("h"), F.col("node")).alias("label")))
        ahead = _largest_before(edges, labels)
        own = lambda c, e: c.select("graph", F.col("node").alias(e), F.col("label").alias(f"{e}_color"))
        inside = _cut(edges.join(own(ahead, "src"), ["graph", "src"]).join(own(ahead, "tgt"), ["graph", "tgt"]).where("src_color = tgt_color").select("graph", "src", "tgt"))
        back = _largest_before(inside.select("graph", F.col("tgt").alias("src"), F.col("src").alias("tgt")), labels)
        both = ahead.join(back.withColumnRenamed("label", "back"), _KEY)
        part = _cut(both.where("label = back").select(*_KEY, F.col("label.node").alias("root")))
        found = part if found is None else found.unionAll(part)
        rest = inside.join(part.select("graph", F.col("node").alias("src")), ["graph", "src"], "left_anti").join(part.select("graph", F.col("node").alias("tgt")), ["graph", "tgt"], "left_anti")
        edges = _peeled(_cut(rest.select("graph", "src", "tgt")))
    if found is None:
        found = loops
    else:
        sizes = found.groupBy("graph", "root").count().where("count > 1").drop("count")
        found = found.join(sizes, ["graph", "root"], "left_semi").select(*_KEY, "root").unionAll(loops.join(found.join(sizes, ["graph", "root"], "left_semi"), _KEY, "left_anti").select(*_KEY, "root"))
    names = found.groupBy("graph", "root").agg(F.min("node").alias("component"))
    return found.join(names, ["graph", "root"]).select(*_KEY, "component")


def cycles(relations: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, node) of the nodes that reach themselves."""
    return strong_components(relations, name).select(*_KEY)


def by_size(rows: DataFrame, whole: Column) -> tuple[DataFrame, DataFrame | None]:
    """Rows (graph, ...) of graphs with at most SMALL of them, dealt out so that a task meets graph after graph; and those of larger
    graphs, of graphs with rows that aren't whole, and without a graph, or None. rows are read twice."""
    counts = rows.groupBy("graph").agg(F.count("*").alias("k"), F.count(F.when(~whole, 1)).alias("bad"))
    large = _cut(counts.where((F.col("k") > SMALL) | (F.col("bad") > 0) | F.col("graph").isNull()).select("graph"))
    if large.isEmpty():
        return rows.repartition("graph").sortWithinPartitions("graph"), None
    rest = rows.join(large, "graph", "left_semi").unionAll(rows.where("graph is null"))
    return rows.where("graph is not null").join(large, "graph", "left_anti").repartition("graph").sortWithinPartitions("graph"), rest


def whole_graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that stand graph after graph, in tables that hold graphs whole."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= CHUNK or size >= CHUNK_BYTES:
            t = pa.Table.from_batches(held).combine_chunks()
            _, g = numbered(t["graph"])
            ends = np.flatnonzero(g[1:] != g[:-1])
            at = int(ends[-1]) + 1 if len(ends) else 0
            if at:
                yield t.slice(0, at)
            held = t.slice(at).to_batches()
            n, size = t.num_rows - at, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def numbered(values: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, and the number of each row's value among them."""
    d = (pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)).dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def numbered_nodes(graph: list[pa.ChunkedArray], node: list[pa.ChunkedArray]) -> tuple[pa.Array, pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Of columns below each other: the graph and the node of each distinct one, each row's number among them, the distinct names
    of nodes, and which of these each distinct one has."""
    below = lambda columns: numbered(pa.chunked_array([x for c in columns for x in c.chunks], columns[0].type))
    (graphs, g), (names, at) = below(graph), below(node)
    own, ids = np.unique(g * len(names) + at, return_inverse=True)
    g, at = np.divmod(own, max(len(names), 1))
    return graphs.take(pa.array(g)), names.take(pa.array(at)), ids, names, at


def layers(src: np.ndarray, tgt: np.ndarray, n: int) -> np.ndarray:
    """The level of each of n nodes, -1 for none."""
    src, tgt = np.divmod(np.unique(src * n + tgt), n)
    first, waits, level = np.searchsorted(src, np.arange(n + 1)), np.bincount(tgt, minlength=n), np.full(n, -1)
    now, k = np.flatnonzero(waits == 0), 0
    while len(now):
        level[now] = k
        counts = first[now + 1] - first[now]
        hit, times = np.unique(tgt[np.repeat(first[now] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())], return_counts=True)
        waits[hit] -= times
        now, k = hit[waits[hit] == 0], k + 1
    return level


def _small_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_graphs(batches):
        graph, node, ids, _, _ = numbered_nodes([t["graph"], t["graph"]], [t["src"], t["tgt"]])
        level = layers(ids[: len(t)], ids[len(t) :], len(node))
        yield pa.RecordBatch.from_arrays([graph, node, pa.array(level.astype(np.int32), mask=level < 0)], ["graph", "node", "level"])


def levels(edges: DataFrame) -> DataFrame:
    """(graph, node, level): the length of the longest way that leads to a node; null for nodes on a cycle and after one. Small
    graphs are taken whole, larger ones level by level. edges: (graph, src, tgt)."""
    graph, node = (edges.select(c).schema[0].dataType for c in ("graph", F.explode(F.array("src", "tgt"))))
    edges = _cut(edges.select("graph", F.col("src").cast(node).alias("src"), F.col("tgt").cast(node).alias("tgt")))
    if not isinstance(graph, T.AtomicType) or not isinstance(node, T.AtomicType):
        return _levels_by_rounds(edges)
    small, rest = by_size(edges, F.col("src").isNotNull() & F.col("tgt").isNotNull())
    out = small.mapInArrow(_small_levels, T.StructType([T.StructField("graph", graph), T.StructField("node", node), T.StructField("level", T.IntegerType())]))
    return out if rest is None else out.unionAll(_levels_by_rounds(rest))


def _levels_by_rounds(edges: DataFrame) -> DataFrame:
    edges = _cut(edges.select("graph", "src", "tgt").distinct())
    waiting = edges.groupBy("graph", F.col("tgt").alias("node")).agg(F.count("*").alias("open"))
    waiting = _cut(edges.select("graph", F.explode(F.array("src", "tgt")).alias("node")).distinct().join(waiting, _KEY, "left").select(*_KEY, F.coalesce("open", F.lit(0)).alias("open")))
    done = None
    for level in itertools.count():
        now = waiting.where("open = 0").select(*_KEY, F.lit(level).alias("level"))
        if now.isEmpty():
            break
        done = now if done is None else done.unionAll(now)
        if level % 8 == 7:
            done = _cut(done)
        gone = edges.join(now.select("graph", F.col("node").alias("src")), ["graph", "src"], "left_semi").groupBy("graph", F.col("tgt").alias("node")).agg(F.count("*").alias("gone"))
        waiting = _cut(waiting.where("open > 0").join(gone, _KEY, "left").select(*_KEY, (F.col("open") - F.coalesce("gone", F.lit(0))).alias("open")))
    rest = waiting.select(*_KEY, F.lit(None).cast("int").alias("level"))
    return rest if done is None else done.unionAll(rest)


def scan_order(edges: DataFrame, clock: DataFrame) -> DataFrame:
    """(graph, node, level, place): nodes in an order in which every edge goes forward, of a level by their clock (graph, node, clock)
    and then by name; nodes without an order have none. Places are numbered by graph."""
    at = clock.join(levels(edges).withColumn("known", F.lit(True)), _KEY, "left")
    at = at.select(*_KEY, F.when(F.col("known").isNull(), 0).otherwise(F.col("level")).alias("level"), "clock")
    # places within (graph, level) first: only counts of levels go through one window
    placed = at.withColumn("within", F.row_number().over(Window.partitionBy("graph", "level").orderBy("clock", "node")))
    sizes = placed.where("level is not null").groupBy("graph", "level").agg(F.max("within").cast("long").alias("count"))
    before = sizes.select("graph", "level", F.coalesce(F.sum("count").over(Window.partitionBy("graph").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, ["graph", "level"], "left").select(*_KEY, "level", (F.col("before") + F.col("within") - 1).alias("place"))


def resolve(relations: DataFrame, starts: DataFrame, nodes: DataFrame, name: str = "selects") -> DataFrame:
    """(graph, node, resolved, steps, reason): where the choices of nodes (graph, node) lead, selection after selection.

    A node points to what its relation name selects (one target at most; check_choices tells of more). nodes: all that exist
    (graph, node). reason: resolved, cycle (a selection leads back), or dangling (to a node that doesn't exist).
    """
    chosen = children(relations, name).groupBy("graph", F.col("src").alias("node")).agg(F.min("tgt").alias("to"))
    known = nodes.select(*_KEY).distinct().withColumn("exists", F.lit(True))
    everyone = chosen.select(*_KEY).unionAll(chosen.select("graph", F.col("to").alias("node"))).unionAll(starts.select(*_KEY)).distinct()
    pointers = everyone.join(chosen, _KEY, "left").join(known, _KEY, "left").select(*_KEY, "to", F.struct(F.col("node").alias("at"), F.col("exists").isNotNull().alias("exists")).alias("value"))
    ends = doubled(pointers)
    size = ends.count()
    reason = F.when(F.col("n") > size, "cycle").when(~F.col("value.exists"), "dangling").otherwise("resolved")
    out = ends.select(*_KEY, F.when(reason == "resolved", F.col("value.at")).alias("resolved"), F.when(reason != "cycle", F.col("n")).alias("steps"), reason.alias("reason"))
    return starts.select(*_KEY).distinct().join(out, _KEY)


def check_choices(relations: DataFrame, alternatives: str = "alternatives", selects: str = "selects") -> DataFrame:
    """(graph, node, reason) of what is wrong with choices: candidates that repeat, several links of one name from a node, a
    selection without alternatives or outside of them. Relations have a column link that tells links of a name apart."""
    own = relations.where(F.col("name").isin(alternatives, selects))
    many = own.groupBy("graph", "src", "name").agg(F.countDistinct("link").alias("n")).where("n > 1").select("graph", F.col("src").alias("node"), F.concat(F.lit("choice event owns at most one "), "name", F.lit(" relation")).alias("reason"))
    twice = own.where(F.col("name") == alternatives).groupBy("graph", "src", "link", "tgt").count().where("count > 1").select("graph", F.col("src").alias("node"), F.lit("choice candidates must be distinct").alias("reason"))
    candidates = own.where(F.col("name") == alternatives).select("graph", "src", "tgt").distinct()
    selected = own.where(F.col("name") == selects).select("graph", "src", "tgt").distinct()
    has = candidates.select("graph", "src").distinct()
    alone = selected.join(has, ["graph", "src"], "left_anti").select("graph", F.col("src").alias("node"), F.lit("selection source owns no alternatives relation").alias("reason"))
    outside = selected.join(has, ["graph", "src"], "left_semi").join(candidates, ["graph", "src", "tgt"], "left_anti").select("graph", F.col("src").alias("node"), F.lit("selection is not a member of alternatives").alias("reason"))
    return many.unionAll(twice).unionAll(alone).unionAll(outside).distinct()
