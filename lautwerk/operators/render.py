"""Text of trees under a profile: what stands around the nodes of each tier, and between their children."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .graph import _cut, children
from .order import by_size, layers, levels, numbered_nodes, whole_graphs


def labels(df: DataFrame, id_col: str, form_col: str) -> DataFrame:
    """(graph, node, tier, text) of the nodes that compare.tree makes of forms; only segments have text."""
    own = df.select(F.col(id_col).cast("string").alias("graph"), F.filter(F.split(F.col(form_col), r"[#‿|‖\s]+"), lambda w: w != "").alias("words"))
    words = own.select("graph", F.posexplode("words").alias("w", "word")).withColumn("node", F.concat(F.lit("w"), "w"))
    syllables = words.select("graph", "node", F.posexplode(F.filter(F.split("word", r"\."), lambda s: s != "")).alias("s", "syllable")).withColumn("node", F.concat("node", F.lit(".s"), "s"))
    segments = syllables.select("graph", "node", F.posexplode(X.units(F.col("syllable"))).alias("u", "text")).withColumn("node", F.concat("node", F.lit(".u"), "u"))
    tier = lambda d, name: d.select("graph", "node", F.lit(name).alias("tier"), F.lit(None).cast("string").alias("text"))
    form = own.select("graph", F.lit("form").alias("node"), F.lit("utterance").alias("tier"), F.lit(None).cast("string").alias("text"))
    return form.unionAll(tier(words, "word")).unionAll(tier(syllables, "syllable")).unionAll(segments.select("graph", "node", F.lit("segment").alias("tier"), "text"))


def render(relations: DataFrame, nodes: DataFrame, profile: DataFrame, name: str = "contains") -> DataFrame:
    """(graph, node, text) of the roots: what stands before a node, its own text, its children's in order with what stands between
    them, and what stands after it. nodes: (graph, node, tier, text); profile: (tier, before, between, after), a row a tier, of which
    missing ones put nothing. A fold from the leaves up: small graphs are taken whole, in larger ones it takes a round for each level.
    Nodes on a cycle have no text.
    """
    rule = profile.groupBy("tier").agg(*(F.first(c).alias(c) for c in ("before", "between", "after")))
    put = lambda c: F.coalesce(c, F.lit(""))
    at = nodes.join(F.broadcast(rule), "tier", "left").select("graph", "node", F.concat(put("before"), put("text")).alias("lead"), put("between").alias("between"), put("after").alias("after"))
    up = children(relations, name).select("graph", "src", "ordinal", "tgt")
    kinds = [up.schema["graph"].dataType, up.schema["src"].dataType]
    if [at.schema["graph"].dataType, at.schema["node"].dataType] != kinds or up.schema["tgt"].dataType != kinds[1] or not all(isinstance(k, T.AtomicType) for k in kinds) or not isinstance(up.schema["ordinal"].dataType, T.IntegralType):
        return _by_rounds(_cut(up), at)
    none = lambda d, c: F.lit(None).cast(d.schema[c].dataType).alias(c)
    links = up.select("graph", F.col("src").alias("node"), "ordinal", "tgt", *(none(at, c) for c in _PUT))
    rows = _cut(at.select("graph", "node", none(up, "ordinal"), none(up, "tgt"), *_PUT, F.lit(True).alias("own")).unionAll(links.withColumn("own", F.lit(False))))
    small, rest = by_size(rows, F.col("node").isNotNull() & (F.col("own") | F.col("tgt").isNotNull() & F.col("ordinal").isNotNull()))
    out = small.mapInArrow(_small_texts, T.StructType([T.StructField("graph", kinds[0]), T.StructField("node", kinds[1]), T.StructField("text", T.StringType())]))
    if rest is None:
        return out
    rest = _cut(rest)
    return out.unionAll(_by_rounds(rest.where("not own").select("graph", F.col("node").alias("src"), "ordinal", "tgt"), rest.where("own").select("graph", "node", *_PUT)))


_PUT = ["lead", "between", "after"]


def _small_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_graphs(batches):
        own, links = t.filter(t["own"]), t.filter(pc.invert(t["own"]))
        graph, node, ids, names, name_of = numbered_nodes([own["graph"], links["graph"], links["graph"]], [own["node"], links["node"], links["tgt"]])
        at, src, tgt = np.split(ids, [len(own), len(own) + len(links)])
        height = layers(tgt, src, len(node))
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        puts: dict[int, list[tuple[str, str, str]]] = {}
        for k, *put in zip(at.tolist(), *(own[c].to_pylist() for c in _PUT)):
            puts.setdefault(k, []).append(put)
        texts = {k: [lead + after for lead, _, after in puts[k]] for k in puts if height[k] == 0}
        # links of a node stand together, nodes by their height
        by = np.lexsort((src, height[src]))
        rows = zip(src[by].tolist(), links["ordinal"].to_numpy()[by].tolist(), rank[name_of[tgt[by]]].tolist(), tgt[by].tolist())
        for k, group in itertools.groupby(rows, itemgetter(0)):
            parts = sorted((o, r, x) for _, o, r, child in group for x in texts.get(child, ()))
            if parts and height[k] > 0 and k in puts:
                texts[k] = [lead + between.join(x for _, _, x in parts) + after for lead, between, after in puts[k]]
        below = np.zeros(len(node), bool)
        below[tgt] = True
        found = [(k, x) for k, own_texts in texts.items() if not below[k] for x in own_texts]
        at = pa.array([k for k, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays([graph.take(at), node.take(at), pa.array([x for _, x in found], pa.string())], ["graph", "node", "text"])


def _by_rounds(up: DataFrame, at: DataFrame) -> DataFrame:
    height = levels(up.select("graph", F.col("tgt").alias("src"), F.col("src").alias("tgt")))
    inner = up.select("graph", F.col("src").alias("node")).distinct().withColumn("inner", F.lit(True))
    at = _cut(at.join(height, ["graph", "node"], "left").join(inner, ["graph", "node"], "left").select("graph", "node", *_PUT, F.when(F.col("inner").isNull(), 0).otherwise(F.col("level")).alias("height")))
    done = _cut(at.where("height = 0").select("graph", "node", F.concat("lead", "after").alias("text")))
    top = at.agg(F.max("height")).first()[0] or 0
    for h in range(1, top + 1):
        now = at.where(F.col("height") == h)
        parts = up.join(now.select("graph", F.col("node").alias("src")), ["graph", "src"], "left_semi").join(done.select("graph", F.col("node").alias("tgt"), "text"), ["graph", "tgt"])
        joined = parts.groupBy("graph", F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "tgt", "text"))).alias("parts"))
        text = F.concat("lead", F.expr("array_join(transform(parts, p -> p.text), between)"), "after")
        done = _cut(done.unionAll(now.join(joined, ["graph", "node"]).select("graph", "node", text.alias("text"))))
    below = up.select("graph", F.col("tgt").alias("node")).distinct()
    return done.join(below, ["graph", "node"], "left_anti")
