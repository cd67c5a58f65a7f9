"""The nearest forms of a table of any size, exactly, by pivots and the triangle inequality.

Each form has coordinates: its distances to a few pivots, of which the empty form is one, so that its length is a band of its
own. Two forms are at least as far apart as any of their coordinates. A form that shares a cell of coordinates gives a first
upper bound; within it lies the nearest one, and only forms all of whose coordinates are that close are compared. Cells are
joined by shuffle, so no list is sent along or held by a task.

Under edits, near forms are found without pivots, as these tell words of like length hardly apart: of k + 1 parts of a form, k
edits leave one as it is, at most k places from where it stood. Forms are joined with the pieces that could be such parts, for
one edit, then two and so on; what has a form that near has its nearest, and only the rest goes on, at last by pivots.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut

Metric = Callable[[Column, Column], Column]
#: Forms of a cell that give its first bound.
REPRESENTATIVES = 4
#: Edits up to which forms are joined by parts; beyond that the parts of words are too short to tell them apart.
BY_PARTS = 4


def edits(left: Column, right: Column) -> Column:
    """Insertions, deletions and substitutions of characters: a metric on forms whose units are characters."""
    return F.levenshtein(left, right)


def _by_parts(asked: DataFrame, own: DataFrame, k: int, allowed: Column) -> DataFrame:
    """(q, b): of each q that has forms x within k edits the nearest, as b (d, x). Each x is cut into k + 1 even parts."""
    cut = lambda i: F.floor(F.col("size") * i / (k + 1)).cast("int")
    length = lambda i: cut(i + 1) - cut(i)
    i, at = F.col("i"), F.col("at")
    parts = own.withColumn("size", F.length("x")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k))))
    parts = parts.select("x", "size", "i", F.substring("x", cut(i) + 1, length(i)).alias("part"))
    n = F.length("q")
    pieces = asked.withColumn("size", F.explode(F.sequence(F.greatest(n - k, F.lit(0)), n + k))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k))))
    pieces = pieces.withColumn("at", F.explode(F.sequence(cut(i) - k, cut(i) + k))).where((at >= 0) & (at + length(i) <= n))
    pieces = pieces.select("q", "size", "i", F.substring("q", at + 1, length(i)).alias("part")).distinct()
    pairs = pieces.join(parts, ["size", "i", "part"]).where(allowed).select("q", "x", F.levenshtein("q", "x", k).alias("d")).where("d >= 0")
    return pairs.groupBy("q").agg(F.min(F.struct("d", "x")).alias("b"))


def nearest(forms: DataFrame, form_col: str, listing: DataFrame, listing_col: str, metric: Metric = edits, pivots: int = 4, other: bool = True) -> DataFrame:
    """(form, nearest, distance): of each distinct form the nearest of a listing, the first by name of several. other: itself doesn't
    count. metric has to be one, with a triangle inequality; distances are compared by their whole part for cells only."""
    own = _cut(listing.select(F.col(listing_col).alias("x")).where("x is not null").distinct())
    asked = _cut(forms.select(F.col(form_col).alias("q")).where("q is not null").distinct())
    allowed = (F.col("q") != F.col("x")) if other else F.lit(True)
    near = []
    if metric is edits:
        for k in range(1 if other else 0, BY_PARTS + 1):
            if asked.isEmpty():
                break
            near.append(_cut(_by_parts(asked, own, k, allowed)))
            asked = _cut(asked.join(near[-1], "q", "left_anti"))
    best = reduce(DataFrame.unionAll, near) if near else None
    if best is None or not asked.isEmpty():
        rest = _by_pivots(asked, own, metric, pivots, other)
        best = rest if best is None else best.unionAll(rest)
    return best.select(F.col("q").alias("form"), F.col("b.x").alias("nearest"), F.col("b.d").alias("distance"))


def _by_pivots(asked: DataFrame, own: DataFrame, metric: Metric, pivots: int, other: bool) -> DataFrame:
    """(q, b): of each q (distinct) the nearest of x (distinct), as b (d, x)."""
    chosen = [r[0] for r in own.orderBy(F.xxhash64("x"), "x").limit(pivots - 1).collect()]
    at = lambda c: F.array(*(metric(F.col(c), F.lit(p)).cast("double") for p in ("", *chosen)))
    cell = lambda coords: F.transform(coords, lambda d: F.floor(d).cast("int"))
    own = _cut(own.withColumn("cx", at("x")).withColumn("cell", cell(F.col("cx"))))
    asked = _cut(asked.withColumn("cq", at("q")).withColumn("cell", cell(F.col("cq"))))
    allowed = (F.col("q") != F.col("x")) if other else F.lit(True)

    few = own.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("x"))).where(F.col("k") <= REPRESENTATIVES).select("cell", "x")
    first = asked.join(few, "cell").where(allowed).groupBy("q").agg(F.min(metric(F.col("q"), F.col("x")).cast("double")).alias("bound"))
    # else a pivot, as far as it is a form of the listing and not the form itself; else any form: the sum of their lengths
    by_pivot = F.array_min(F.transform(F.arrays_zip(F.slice("cq", 2, len(chosen)).alias("d"), F.array(*map(F.lit, chosen)).alias("p")), lambda z: F.when(z["p"] != F.col("q") if other else F.lit(True), z["d"]))) if chosen else F.lit(None).cast("double")
    longest = own.agg(F.max(F.col("cx")[0]).alias("longest"))
    bounded = asked.join(first, "q", "left").crossJoin(F.broadcast(longest)).select("q", "cq", F.coalesce("bound", by_pivot, F.col("cq")[0] + F.col("longest")).alias("bound"))

    # two coordinates make the cells that are joined; the others only filter
    span = lambda k: F.sequence(F.floor(F.col("cq")[k] - F.col("bound")).cast("int"), F.floor(F.col("cq")[k] + F.col("bound")).cast("int"))
    wanted = bounded.withColumn("c0", F.explode(span(0)))
    wanted = wanted.withColumn("c1", F.explode(span(1))) if chosen else wanted.withColumn("c1", F.lit(0))
    cells = own.select("x", "cx", F.col("cell")[0].alias("c0"), (F.col("cell")[1] if chosen else F.lit(0)).alias("c1"))
    close = reduce(lambda a, b: a & b, (F.abs(F.col("cq")[k] - F.col("cx")[k]) <= F.col("bound") for k in range(len(chosen) + 1)))
    pairs = wanted.join(cells, ["c0", "c1"]).where(close & allowed).select("q", "x", metric(F.col("q"), F.col("x")).alias("d"))
    return pairs.groupBy("q").agg(F.min(F.struct("d", "x")).alias("b"))
