"""Comparing forms: traces, typed disagreements, directional costs, thresholds, trajectories and trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import inventory as I
from ..functions import text as X
from . import distance as D

_STEPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("left", T.StringType()), T.StructField("right", T.StringType()), T.StructField("cost", T.DoubleType())]))


def alignment(left: Column, right: Column, matches: bool = True) -> Column:
    """Steps (op, left, right, cost) of two forms; null if either is. matches: those of equal units, too."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [dict(zip(("op", "left", "right", "cost"), s, strict=True)) for s in D.explain_word_distance(list(x), list(y)) if matches or s[0] != "match"] for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, _STEPS)(X.units(left), X.units(right))


def disagreements(df: DataFrame, keys: list[str], reference_col: str, source_col: str) -> DataFrame:
    """(keys, kind, left, right): FEATURE where units were substituted, STRUCTURE where one side has a unit alone."""
    steps = df.select(*keys, F.explode_outer(alignment(F.col(reference_col), F.col(source_col), matches=False)).alias("s")).where("s.op <> 'match'")
    return steps.select(*keys, F.when(F.col("s.op") == "sub", "FEATURE").otherwise("STRUCTURE").alias("kind"), F.col("s.left").alias("left"), F.col("s.right").alias("right"))


def directional_distance(left: Column, right: Column, delete: dict[str, float] | None = None, insert: dict[str, float] | None = None, default: float = D.GAP) -> Column:
    """Cost of turning the left form into the right one with prices of one's own for deleted and inserted units; a substitution costs
    both of them times the distance of the units."""
    gone, new = delete or {}, insert or {}

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.nan if x is None or y is None else _cost(list(x), list(y), gone, new, default) for x, y in zip(a, b, strict=True)])

    return F.nanvl(F.pandas_udf(run, T.DoubleType())(X.units(left), X.units(right)), F.lit(None))


def _cost(a: list[str], b: list[str], gone: dict[str, float], new: dict[str, float], default: float) -> float:
    row = np.concatenate([[0.0], np.cumsum([new.get(u, default) for u in b])])
    for x in a:
        out_price = gone.get(x, default)
        nxt = np.empty_like(row)
        nxt[0] = row[0] + out_price
        for j, y in enumerate(b):
            in_price = new.get(y, default)
            nxt[j + 1] = min(row[j] + (out_price + in_price) * D.phone_distance(x, y), row[j + 1] + out_price, nxt[j] + in_price)
        row = nxt
    return float(row[-1])


def is_similar(left: Column, right: Column, least: float) -> Column:
    """Whether forms are similar enough; where their lengths alone rule it out, nothing is aligned."""
    n, m = F.size(X.units(left)), F.size(X.units(right))
    possible = 2 * F.least(n, m) >= least * (n + m)
    # the UDF skips nulls
    cost = D.sequence_distance(F.when(possible, X.units(left)), X.units(right))
    return F.when(left.isNull() | right.isNull(), None).when(n + m == 0, True).when(~possible, False).otherwise(1 - cost / (n + m) >= least)


def tree(df: DataFrame, id_col: str, form_col: str) -> DataFrame:
    """Containment of forms as relations (graph, name, src, ordinal, tgt): form, words, syllables, segments. Paths are the names."""
    words = df.select(F.col(id_col).cast("string").alias("graph"), F.posexplode(F.filter(F.split(F.col(form_col), r"[#‿|‖\s]+"), lambda w: w != "")).alias("w", "word"))
    words = words.select("graph", F.lit("form").alias("src"), F.col("w").alias("ordinal"), F.concat(F.lit("w"), "w").alias("tgt"), "word")
    syllables = words.select("graph", F.col("tgt").alias("src"), F.posexplode(F.filter(F.split("word", r"\."), lambda s: s != "")).alias("ordinal", "syllable"))
    syllables = syllables.withColumn("tgt", F.concat("src", F.lit(".s"), "ordinal"))
    segments = syllables.select("graph", F.col("tgt").alias("src"), F.posexplode(X.units(F.col("syllable"))).alias("ordinal", "unit"))
    segments = segments.select("graph", "src", "ordinal", F.concat("src", F.lit(".u"), "ordinal").alias("tgt"))
    return words.select("graph", "src", "ordinal", "tgt").unionAll(syllables.select("graph", "src", "ordinal", "tgt")).unionAll(segments).select("graph", F.lit("contains").alias("name"), "src", "ordinal", "tgt")


def to_dot(relations: DataFrame) -> DataFrame:
    """(graph, dot): text of each graph, its edges in order; a graph is one form's and thus small."""
    edge = F.concat(F.lit('"'), "src", F.lit('" -> "'), "tgt", F.lit('" [label="'), "name", F.lit('"];'))
    lines = relations.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("src", "name", "ordinal", "tgt", edge.alias("edge")))).alias("rows"))
    return lines.select("graph", F.concat(F.lit("digraph {\n"), F.array_join(F.transform("rows", lambda r: r["edge"]), "\n"), F.lit("\n}")).alias("dot"))


def trajectory(df: DataFrame, form_col: str, frames_per_unit: int = 4) -> DataFrame:
    """df's columns with frame, arc and offset: the constriction moving in straight lines from unit to unit, at even steps."""
    points = {s: D.tract_point(b) for s, b in I.full().items()}
    arc = F.create_map(*(x for s, (p, _) in points.items() if p is not None for x in (F.lit(s), F.lit(p))))
    off = F.create_map(*(x for s, (_, o) in points.items() for x in (F.lit(s), F.lit(o))))
    u = F.transform(X.units(F.col(form_col)), lambda t: X.decode(F.regexp_extract(X.encode(t), f"({X.base_class()})", 1)))
    arcs, offs = X.free(df, "__arc"), X.free(df, "__off")
    base = df.withColumn(arcs, F.transform(u, lambda t: F.try_element_at(arc, t))).withColumn(offs, F.transform(u, lambda t: F.try_element_at(off, t)))
    n = F.size(arcs)
    rows = base.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), (n - 1) * frames_per_unit)).alias("frame"))
    k, t = F.floor(F.col("frame") / frames_per_unit).cast("int"), (F.col("frame") % frames_per_unit) / frames_per_unit
    mix = lambda c: F.when(t == 0, F.get(c, k)).otherwise(F.get(c, k) * (1 - t) + F.get(c, k + 1) * t)
    return rows.select(*df.columns, "frame", mix(arcs).alias("arc"), mix(offs).alias("offset"))


def unit_extents(df: DataFrame, form_col: str, frames_per_unit: int = 4) -> DataFrame:
    """df's columns with place, unit, first and last: the frames of a trajectory in which each unit is the nearer one."""
    units = X.units(F.col(form_col))
    rows = df.select("*", F.posexplode(units).alias("place", "unit"))
    half = frames_per_unit // 2
    n = F.size(units)
    first = F.when(F.col("place") == 0, 0).otherwise(F.col("place") * frames_per_unit - half + (0 if frames_per_unit % 2 else 1))
    last = F.when(F.col("place") == n - 1, (n - 1) * frames_per_unit).otherwise(F.col("place") * frames_per_unit + half)
    return rows.select(*df.columns, "place", "unit", first.alias("first"), last.alias("last"))


def track(df: DataFrame, id_col: str, form_col: str, frame_rate: float = 100.0, frames_per_unit: int = 4) -> DataFrame:
    """(id, seconds, arc, offset): a trajectory in time, at so many frames a second."""
    t = trajectory(df.select(F.col(id_col).alias("id"), F.col(form_col).alias("form")), "form", frames_per_unit)
    return t.select("id", (F.col("frame") / F.lit(frame_rate)).alias("seconds"), "arc", "offset")


def costs_identity(delete: dict[str, float] | None = None, insert: dict[str, float] | None = None, default: float = D.GAP) -> str:
    """Digest of the prices of a directional distance."""
    from ..functions.segments import identity_fingerprint

    return identity_fingerprint({"delete": delete or {}, "insert": insert or {}, "default": default})
