"""Graphs built from tables of events, with names that come from what they name.

A node's id is a digest of its tier and of the values that identify it, so that loads in any order, or twice, give the same
nodes, and graphs are merged by id. Spans come from events that open and close them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity(tier: str, *values: Column) -> Column:
    """A digest of a tier and some values; null has a spelling of its own, and no value runs into the next."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", F.lit(tier), *map(part, values)), 256)


def nodes(rows: DataFrame, tier: str, by: list[str]) -> DataFrame:
    """(node, tier, and the columns of by) of the distinct values of by."""
    return rows.select(*by).distinct().select(identity(tier, *(F.col(c) for c in by)).alias("node"), F.lit(tier).alias("tier"), *by)


def spans(events: DataFrame, by: list[str], t: str, kind: str, begin: str, end: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """Spans (by, start, stop) and what is left over (by, t, reason), from events of two kinds within the groups of by.

    An event that begins a span is closed by the next event of its group if that ends one; else it is unfinished. One that ends
    without an open span is a stray. Events of one time are in the order of column tie.
    """
    order = Window.partitionBy(*by).orderBy(t, tie)
    own = events.where(F.col(kind).isin(begin, end)).select(*by, F.col(t).alias("t"), F.col(kind).alias("k"), F.lead(F.col(kind)).over(order).alias("next"), F.lead(t).over(order).alias("stop"), F.lag(F.col(kind)).over(order).alias("prior"))
    found = own.where((F.col("k") == begin) & (F.col("next") == end)).select(*by, F.col("t").alias("start"), "stop")
    open_ = own.where((F.col("k") == begin) & ((F.col("next") == begin) | F.col("next").isNull())).select(*by, "t", F.lit("unfinished").alias("reason"))
    stray = own.where((F.col("k") == end) & ((F.col("prior") == end) | F.col("prior").isNull())).select(*by, "t", F.lit("stray").alias("reason"))
    return found, open_.unionAll(stray)


def relation(rows: DataFrame, graph: Column, name: str, src: Column, tgt: Column, order: Column) -> DataFrame:
    """(graph, name, src, ordinal, tgt) with ordinals by order within a source."""
    own = rows.select(graph.alias("graph"), F.lit(name).alias("name"), src.alias("src"), order.alias("o"), tgt.alias("tgt")).distinct()
    at = F.row_number().over(Window.partitionBy("graph", "src").orderBy("o", "tgt")) - 1
    return own.select("graph", "name", "src", at.cast("int").alias("ordinal"), "tgt")


def merge(*tables: DataFrame) -> DataFrame:
    """Nodes of several loads, each once."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["node"])
