"""Tier graphs as tables of relations (graph, name, src, ordinal, tgt): navigation and checks.

Paths are followed round by round with joins; every round is written to the shared folder, so lineage stays short and a
lost executor costs one round. Nodes that were found aren't followed again, so cycles end too.
"""

from __future__ import annotations

import atexit
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch


def _cut(df: DataFrame) -> DataFrame:
    """Written to the folder that the session names for checkpoints and read again; removed when Python ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter
        return


def children(relations: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, src, ordinal, tgt) of one relation."""
    return relations.where(F.col("name") == name).select("graph", "src", "ordinal", "tgt")


def descendants(relations: DataFrame, roots: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, root, node, depth): all that roots (graph, root) reach, by the shortest way."""
    own = children(relations, name)
    level = roots.select("graph", "root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    found = level
    for depth in itertools.count(1):
        nxt = level.join(own, (level["graph"] == own["graph"]) & (level["node"] == own["src"])).select(level["graph"], "root", F.col("tgt").alias("node"), F.lit(depth).alias("depth")).distinct()
        level = _cut(nxt.join(found.select("graph", "root", "node"), ["graph", "root", "node"], "left_anti"))
        if level.isEmpty():
            break
        found = found.unionAll(level)
        if depth % 8 == 0:  # keeps the plan short
            found = _cut(found)
    return found.where("depth > 0")


def leaves(relations: DataFrame, roots: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, root, node, depth) of the descendants that contain nothing."""
    own = children(relations, name).select("graph", F.col("src").alias("node")).distinct()
    return descendants(relations, roots, name).join(own, ["graph", "node"], "left_anti").select("graph", "root", "node", "depth")


def parents(relations: DataFrame, name: str = "contains") -> DataFrame:
    return children(relations, name).select("graph", F.col("tgt").alias("node"), F.col("src").alias("parent")).distinct()


def cycles(relations: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, node) that reach themselves: the nodes of strongly connected components (see order)."""
    from .order import cycles as on_cycles

    return on_cycles(relations, name)


def descendants_on_tier(relations: DataFrame, roots: DataFrame, tiers: DataFrame, tier: str, name: str = "contains") -> DataFrame:
    """(graph, root, node, depth) of the descendants that stand on a tier; tiers: (graph, node, tier)."""
    own = tiers.where(F.col("tier") == tier).select("graph", "node").distinct()
    return descendants(relations, roots, name).join(own, ["graph", "node"], "left_semi").select("graph", "root", "node", "depth")


def lexical_projection(relations: DataFrame, tiers: DataFrame, tier: str, name: str = "contains") -> DataFrame:
    """(graph, src, ordinal, tgt): the direct children that stand on a tier, without siblings of other tiers."""
    own = tiers.where(F.col("tier") == tier).select("graph", F.col("node").alias("tgt")).distinct()
    return children(relations, name).join(own, ["graph", "tgt"], "left_semi").select("graph", "src", "ordinal", "tgt")


def ancestors(relations: DataFrame, nodes: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, node, ancestor, depth): all that contain the nodes (graph, node), by the shortest way."""
    up = children(relations, name).select("graph", F.lit(name).alias("name"), F.col("tgt").alias("src"), F.lit(0).alias("ordinal"), F.col("src").alias("tgt"))
    found = descendants(up, nodes.select("graph", F.col("node").alias("root")), name)
    return found.select("graph", F.col("root").alias("node"), F.col("node").alias("ancestor"), "depth")


def ancestor_routes(relations: DataFrame, nodes: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, node, route): every way from a parent of the nodes up to a root, parent first. A way doesn't pass a node twice; one
    that can only go on in circles ends nowhere and is left out. The number of ways is the graph's own, as in a lattice."""
    up = children(relations, name).select("graph", F.col("tgt").alias("__at"), F.col("src").alias("__up")).distinct()
    roots = up.select("graph", F.col("__up").alias("__at")).distinct().join(up, ["graph", "__at"], "left_anti")
    level = nodes.select("graph", "node").distinct().join(up.withColumnRenamed("__at", "node"), ["graph", "node"]).select("graph", "node", F.array("__up").alias("route"))
    done = None
    while True:
        level = _cut(level.withColumn("__at", F.element_at("route", -1)))
        ended = level.join(roots, ["graph", "__at"], "left_semi").select("graph", "node", "route")
        done = ended if done is None else done.unionAll(ended)
        level = level.join(up, ["graph", "__at"]).where(~F.array_contains("route", F.col("__up"))).select("graph", "node", F.array_append("route", F.col("__up")).alias("route"))
        if level.isEmpty():
            return done


def walk(relations: DataFrame, roots: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, root, place, node): descendants in walk order, children in their declared order and each node where it is first met.
    Ways are arrays of ordinals, which sort as the walk goes; of several ways to a node the first is kept in each round."""
    own = children(relations, name)
    level = roots.select("graph", "root", F.col("root").alias("node"), F.array().cast("array<int>").alias("way"))
    found = None
    while True:
        nxt = level.join(own, (level["graph"] == own["graph"]) & (level["node"] == own["src"])).select(level["graph"], "root", F.col("tgt").alias("node"), F.array_append("way", F.col("ordinal").cast("int")).alias("way"))
        nxt = nxt.where(F.col("node") != F.col("root")).groupBy("graph", "root", "node").agg(F.min("way").alias("way"))
        if found is not None:  # a node is followed again only when an earlier way to it was found
            old = found.withColumnRenamed("way", "old")
            nxt = nxt.join(old, ["graph", "root", "node"], "left").where(F.col("old").isNull() | (F.col("way") < F.col("old"))).drop("old")
        level = _cut(nxt)
        if level.isEmpty():
            break
        found = _cut((level if found is None else found.unionAll(level)).groupBy("graph", "root", "node").agg(F.min("way").alias("way")))
    if found is None:
        return level.select("graph", "root", F.lit(0).cast("long").alias("place"), "node")
    order = Window.partitionBy("graph", "root").orderBy("way")
    return found.select("graph", "root", (F.row_number().over(order) - 1).cast("long").alias("place"), "node")


def expand_phrase(relations: DataFrame, roots: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, root, place, node): the leaves below the roots, in walk order."""
    inner = children(relations, name).select("graph", F.col("src").alias("node")).distinct()
    left = walk(relations, roots, name).join(inner, ["graph", "node"], "left_anti")
    order = Window.partitionBy("graph", "root").orderBy("place")
    return left.select("graph", "root", (F.row_number().over(order) - 1).cast("long").alias("place"), "node")


def graph_roots(relations: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, node) that contain something and are contained in nothing."""
    own = children(relations, name)
    return own.select("graph", F.col("src").alias("node")).distinct().join(own.select("graph", F.col("tgt").alias("node")).distinct(), ["graph", "node"], "left_anti")


# -- building and changing -------------------------------------------------------------------------------------------


def contain(relations: DataFrame, pairs: DataFrame, name: str = "contains") -> DataFrame:
    """relations with each (graph, src, tgt) of pairs appended to the children that src has, in the order of column ordinal."""
    last = children(relations, name).groupBy("graph", "src").agg((F.max("ordinal") + 1).alias("next"))
    order = Window.partitionBy("graph", "src").orderBy("ordinal", "tgt")
    new = pairs.withColumn("at", F.row_number().over(order) - 1).join(last, ["graph", "src"], "left")
    new = new.select("graph", F.lit(name).alias("name"), "src", (F.coalesce("next", F.lit(0)) + F.col("at")).cast("int").alias("ordinal"), "tgt")
    return relations.select("graph", "name", "src", F.col("ordinal").cast("int").alias("ordinal"), "tgt").unionByName(new)


def remove_nodes(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """relations without the nodes (graph, node) and what leads to or from them; the ordinals that are left close up."""
    gone = nodes.select("graph", "node").distinct()
    kept = relations
    for end in ("src", "tgt"):
        kept = kept.join(gone.withColumnsRenamed({"node": end}), ["graph", end], "left_anti")
    order = Window.partitionBy("graph", "name", "src").orderBy("ordinal", "tgt")
    return kept.select("graph", "name", "src", (F.row_number().over(order) - 1).cast("int").alias("ordinal"), "tgt")


def relation_violations(relations: DataFrame, declared: DataFrame) -> DataFrame:
    """(graph, name, src, reason): relations that aren't declared, sources with more targets than a relation may have, ordered
    relations with a gap or a repeat in their ordinals, acyclic ones with a cycle. declared: (name, most, ordered, acyclic)."""
    unknown = relations.join(F.broadcast(declared.select("name")), "name", "left_anti").select("graph", "name", "src", F.lit("not declared").alias("reason"))
    by = relations.join(F.broadcast(declared), "name").groupBy("graph", "name", "src", "most", "ordered").agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("places"), F.max("ordinal").alias("last"), F.min("ordinal").alias("first"))
    many = by.where("n > most").select("graph", "name", "src", F.lit("too many targets").alias("reason"))
    gaps = by.where("ordered and (places <> n or first <> 0 or last <> n - 1)").select("graph", "name", "src", F.lit("ordinals").alias("reason"))
    out = unknown.unionAll(many).unionAll(gaps)
    for (name,) in declared.where("acyclic").select("name").collect():  # the declaration of a kind of graph, a few rows
        out = out.unionAll(cycles(relations, name).select("graph", F.lit(name).alias("name"), F.col("node").alias("src"), F.lit("cycle").alias("reason")))
    return out.distinct()


def choice_violations(relations: DataFrame) -> DataFrame:
    """(graph, src, reason): more than one selection, or a selection that isn't among the alternatives."""
    alternatives = relations.where("name = 'alternatives'").select("graph", "src", "tgt").distinct()
    selected = relations.where("name = 'selects'").select("graph", "src", "tgt")
    many = selected.groupBy("graph", "src").count().where("count > 1").select("graph", "src", F.lit("several selections").alias("reason"))
    alien = selected.join(alternatives, ["graph", "src", "tgt"], "left_anti").select("graph", "src", F.lit("not an alternative").alias("reason"))
    return many.unionAll(alien).distinct()


# -- events, serialisation -------------------------------------------------------------------------------------------


def events_at(events: DataFrame, tier: str, tick: int) -> DataFrame:
    """Events (graph, node, tier, tick, idx) of a tier that stand at a tick of the clock, in their order there."""
    return events.where((F.col("tier") == tier) & (F.col("tick") == tick)).orderBy("graph", "idx")


def positions(events: DataFrame) -> DataFrame:
    """(graph, node, tier, place): the place of each event on its tier."""
    order = Window.partitionBy("graph", "tier").orderBy("tick", "idx", "node")
    return events.select("graph", "node", "tier", (F.row_number().over(order) - 1).cast("long").alias("place"))


def references(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph, node, name, other, role): every relation that names one of the nodes, with the part it plays there."""
    as_source = relations.select("graph", F.col("src").alias("node"), "name", F.col("tgt").alias("other"), F.lit("source").alias("role"))
    as_target = relations.select("graph", F.col("tgt").alias("node"), "name", F.col("src").alias("other"), F.lit("target").alias("role"))
    return as_source.unionAll(as_target).join(nodes.select("graph", "node").distinct(), ["graph", "node"], "left_semi")


def to_json(relations: DataFrame) -> DataFrame:
    """(graph, data): each graph's relations as versioned JSON in canonical order; a graph is one form's and thus small."""
    rows = relations.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("src", "name", F.col("ordinal").cast("int").alias("ordinal"), "tgt"))).alias("links"))
    return rows.select("graph", F.to_json(F.struct(F.lit("tiergraph").alias("type"), F.lit(1).alias("v"), "links")).alias("data"))


def from_json(data: DataFrame) -> DataFrame:
    """Relations of (graph, data); those of another type or version are left out."""
    x = F.from_json("data", "type string, v int, links array<struct<src:string,name:string,ordinal:int,tgt:string>>")
    return data.select("graph", x.alias("x")).where("x.type = 'tiergraph' and x.v = 1").select("graph", F.explode("x.links").alias("l")).select("graph", "l.name", "l.src", "l.ordinal", "l.tgt")
