"""Phone distance, word alignment, ranking and the percentile model.

The table of phone distances comes from the inventory alone, so it is small at any size of the data. Word alignment is a
dynamic program over Arrow batches: sequences of equal length are aligned together, one anti-free row step for all.
"""

from __future__ import annotations

import itertools
import json
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import inventory as I
from ..functions import text as X

GAP = 1.0
#: Pairs of sequences that are aligned at once.
ALIGNED = 20_000
_LEFT_OUT = {*I.SECONDARY, "length", "stress", "tone", "place", "location", "glide-height", "glide-backness"}  # location is compared as tract-x


# -- phones -----------------------------------------------------------------------------------------------------------


def _comparable(b: dict[str, str]) -> dict[str, str]:
    """Features that are compared as such, with the articulator and what several spellings mean alike."""
    out = {k: v for k, v in b.items() if k not in _LEFT_OUT}
    out["nasality"] = "+" if b.get("manner") == "nasal" or b.get("nasalized") == "+" or b.get("release") == "nasal" else "-"
    out["laterality"] = "+" if b.get("channel") == "lateral" or b.get("release") == "lateral" else "-"
    return out


def _places(b: dict[str, str]) -> list[tuple[float, float]]:
    """(arc, weight) of the constrictions: primary ones 1, secondary ones less."""
    out = [(I.PLACES[p], 1.0) for p in b.get("place", "").split("^") if p in I.PLACES]
    return out + [(I.PLACES[p], I.SECONDARY_WEIGHT) for f, p in I.SECONDARY.items() if b.get(f) == "+"]


def _sided(xs: list[tuple[float, float]], ys: list[tuple[float, float]]) -> float:
    return sum(w * min(abs(x - y) for y, _ in ys) for x, w in xs) / sum(w for _, w in xs)


def tract_point(b: dict[str, str]) -> tuple[float | None, float]:
    """(arc, offset): where along the tract, and how closed; of several places the mean arc."""
    arcs = tract_arcs(b)
    offset = I.HEIGHTS.get(b.get("height", ""), 0.0) if b.get("manner") == "vowel" else I.MANNERS.get(b.get("manner", ""), 0.0)
    return (sum(arcs) / len(arcs) if arcs else None), offset


def tract_arcs(b: dict[str, str]) -> tuple[float, ...] | None:
    """All arcs at which a bundle constricts, front to back; None for a rhotic vowel, which has no one place."""
    if b.get("rhotacized") == "+":
        return None
    if b.get("manner") == "vowel":
        at = I.BACKNESS.get(b.get("location", b.get("backness", "")))
        return () if at is None else (at,)
    arcs = {I.PLACES[p] for p in b.get("place", "").split("^") if p in I.PLACES}
    if b.get("airstream") == "click" and arcs:
        arcs.add(I.PLACES["velar"])  # a click closes there, too
    return tuple(sorted(arcs))


def terms(a: dict[str, str], b: dict[str, str]) -> dict[str, float]:
    """The terms of the distance of two bundles."""
    x, y = _comparable(a), _comparable(b)
    out = {f: (I.value_distance(f, x[f], y[f]) if f in x and f in y else 1.0) for f in sorted({*x, *y})}
    p, q = _places(a), _places(b)
    if p or q:
        out["place"] = _both(p, q)
    arts = [[(I.ARTICULATOR_ARCS[I.ARTICULATORS[s]], 1.0) for s in z.get("place", "").split("^") if s in I.ARTICULATORS] for z in (a, b)]
    if any(arts):
        out["articulator"] = _both(*arts)
    ax, bx = tract_arcs(a), tract_arcs(b)
    if ax is not None and bx is not None and (ax or bx):
        out["tract-x"] = _both([(v, 1.0) for v in ax], [(v, 1.0) for v in bx])
    out["tract-y"] = abs(tract_point(a)[1] - tract_point(b)[1])
    return out


def _both(xs: list[tuple[float, float]], ys: list[tuple[float, float]]) -> float:
    """The larger of the two directional best matches; 1 where one side has none."""
    return max(_sided(xs, ys), _sided(ys, xs)) if xs and ys else 1.0


def bundle_distance(a: dict[str, str], b: dict[str, str]) -> float:
    own = terms(a, b)
    return sum(sorted(own.values())) / len(own)


@dataclass(frozen=True)
class Parts:
    """A unit as its constituents' bundles, the senses of the ties between them (fuse, seq), and its prosody."""

    bundles: tuple[tuple[tuple[str, str], ...], ...]
    ties: tuple[str, ...] = ()
    prosody: tuple[tuple[str, str], ...] = ()

    def cut(self, starts: list[int]) -> list[Parts]:
        ends = [*starts[1:], len(self.bundles)]
        return [Parts(self.bundles[s:e], self.ties[s : e - 1]) for s, e in zip(starts, ends, strict=True)]

    @property
    def blocks(self) -> list[int]:
        """Starts of the runs of one manner: the phases."""
        manner = [dict(b).get("manner") for b in self.bundles]
        return [i for i in range(len(manner)) if not i or manner[i] != manner[i - 1]]

    @property
    def ordered(self) -> bool:
        return "seq" in self.ties or len(self.blocks) > 1

    @property
    def children(self) -> list[Parts]:
        """Runs between sequential ties, else phases, else the constituents; an atomic unit is its own only part."""
        if len(self.bundles) == 1:
            return [Parts(self.bundles)]
        if "seq" in self.ties:
            return self.cut([0, *(i + 1 for i, t in enumerate(self.ties) if t == "seq")])
        return self.cut(self.blocks if len(self.blocks) > 1 else list(range(len(self.bundles))))


@cache
def parts_of(unit: str) -> Parts | None:
    """None for a unit that can't be read."""
    marks = {m: v for m, v in I.PROSODY.items()}
    prosody: dict[str, str] = {}
    for c in unit:
        if c in marks and ">" not in marks[c][1]:  # a contour isn't a point on a scale
            prosody[marks[c][0]] = marks[c][1]
    body = "".join(c for c in unit if c not in marks)
    found = [I.bundle_of(c) for c in re.split(f"[{I.TIE}{I.SEQUENCE}]", body)]
    if any(b is None for b in found):
        return None
    ties = tuple("seq" if c == I.SEQUENCE else "fuse" for c in body if c in (I.TIE, I.SEQUENCE))
    return Parts(tuple(tuple(sorted(b.items())) for b in found), ties, tuple(sorted(prosody.items())))


@cache
def arity_cost() -> float:
    """What one more constituent of an unordered fusion costs: one term of the speech symbol that has the fewest, of those with a place."""
    return 1 / min(len(terms(b, b)) for s, b in I.full().items() if len(s) == 1 and tract_arcs(b))


def prosodic_terms(x: Parts, y: Parts) -> dict[str, float]:
    """A term for each tier that either unit is marked on. An unmarked unit has the tier's neutral value; tone has none."""
    a, b = dict(x.prosody), dict(y.prosody)
    neutral = {"stress": "unstressed", "length": "normal"}
    out = {}
    for f in sorted({*a, *b}):
        v, w = a.get(f, neutral.get(f)), b.get(f, neutral.get(f))
        out[f] = I.value_distance(f, v, w) if v and w else 1.0
    return out


@cache
def segment_distance(x: Parts, y: Parts) -> float:
    """Distance of two units by their structure. Parts that stand in order are matched in order, each of the shorter side with one
    of the other; what is left over costs its nearest part and a term of its own; ties are terms. Parts in no order are matched
    with their nearest ones, and what one side has more of costs arity_cost each."""
    rider = prosodic_terms(x, y)
    silent = [any(dict(b).get("manner") == "silence" for b in z.bundles) for z in (x, y)]
    if silent[0] != silent[1]:
        return 1.0
    if len(x.bundles) == len(y.bundles) == 1:
        own = terms(dict(x.bundles[0]), dict(y.bundles[0]))
        return (sum(sorted(own.values())) + sum(rider.values())) / (len(own) + len(rider))
    px, py = x.children, y.children
    near = [[segment_distance(a, b) for b in py] for a in px]
    if x.ordered or y.ordered:
        cost = _in_order(px, py, near, *("seq" if "seq" in z.ties else "fuse" for z in (x, y)))
    else:
        to_y, to_x = sum(min(r) for r in near) / len(px), sum(min(c) for c in zip(*near, strict=True)) / len(py)
        cost = min(1.0, max(to_y, to_x) + abs(len(px) - len(py)) * arity_cost())
    weight = max(len(px), len(py))
    return (cost * weight + sum(rider.values())) / (weight + len(rider)) if rider else cost


def _in_order(px: list[Parts], py: list[Parts], near: list[list[float]], tie_x: str, tie_y: str) -> float:
    """The cheapest way to match parts in order. Every part of the shorter side makes a pair: ways that leave parts of both sides
    over would bring units nearer by what they don't share."""
    n, m = len(px), len(py)
    short = min(n, m)
    gaps = n + m - 2 * short
    best = 1.0
    for rows in itertools.combinations(range(n), short):
        for cols in itertools.combinations(range(m), short):
            pairs = list(zip(rows, cols, strict=True))
            left = sum(min(near[i]) for i in range(n) if i not in rows) + sum(min(near[i][j] for i in range(n)) for j in range(m) if j not in cols)
            joined = sum(b == (a[0] + 1, a[1] + 1) for a, b in itertools.pairwise(pairs))
            loose = n - 1 + m - 1 - 2 * joined
            ties = joined * (tie_x != tie_y) + loose
            best = min(best, (sum(near[i][j] for i, j in pairs) + left + ties) / (short + 2 * gaps + joined + loose))
    return best


@cache
def phone_distance(a: str, b: str) -> float:
    """0 for a unit and itself, 1 where either can't be read or one is silence."""
    if a == b:
        return 0.0
    x, y = parts_of(a), parts_of(b)
    return 1.0 if x is None or y is None else segment_distance(x, y)


def segment_terms(a: str, b: str) -> list[tuple[str, float]]:
    """(term, cost) of the distance of two atomic units; of others (child against child, cost) of all pairs."""
    x, y = parts_of(a), parts_of(b)
    if x is None or y is None:
        return [("unreadable", float(a != b))]
    if len(x.bundles) == len(y.bundles) == 1:
        own = terms(dict(x.bundles[0]), dict(y.bundles[0])) | {f"{f} (prosodic)": v for f, v in prosodic_terms(x, y).items()}
        return sorted(own.items())
    return [(f"part {i} against {j}", segment_distance(p, q)) for i, p in enumerate(x.children) for j, q in enumerate(y.children)]


@cache
def matrix() -> np.ndarray:
    own = I.phones()
    out = np.zeros((len(own), len(own)))
    for i, a in enumerate(own):
        for j in range(i):
            out[i, j] = out[j, i] = phone_distance(a, own[j])
    return out


def distance_table(spark: SparkSession) -> DataFrame:
    """(a, b, d) of all ordered pairs of speech phones; bounded by the inventory."""
    own, m = I.phones(), matrix()
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(own) for j, b in enumerate(own) if I.SILENCE not in (a, b)]
    return spark.createDataFrame(rows, "a string, b string, d double")


def metric_fingerprint() -> str:
    """Digest of all that a distance depends on."""
    return sha256(json.dumps([I.full(), I.PLACES, I.MANNERS, I.HEIGHTS, I.BACKNESS, I.CHANNELS, I.SECONDARY], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def nearest_phones(spark: SparkSession, n: int = 5, among: list[str] | None = None) -> DataFrame:
    """(a, b, d, rank): the n nearest phones of each, of all or among those given, ties by spelling."""
    w = Window.partitionBy("a").orderBy(F.round("d", 9), "b")
    own = distance_table(spark).where("a <> b")
    own = own.where(F.col("a").isin(among) & F.col("b").isin(among)) if among else own
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shortened(least: float = 1e-12) -> list[tuple[str, str, float, float]]:
    """(a, b, distance, shortest): pairs of phones that the closure brings nearer."""
    own, d, c = I.phones(), matrix(), metric_closure()
    return [(own[i], own[j], float(d[i, j]), float(c[i, j])) for i in range(len(own)) for j in range(i) if d[i, j] - c[i, j] > least]


def minimal_pairs(spark: SparkSession) -> DataFrame:
    """(a, b, feature): phones whose bundles differ in one feature only."""
    own = I.full()
    rows = [(a, b, d[0]) for a in own for b in own if a < b and I.SILENCE not in (a, b) and len(d := [f for f in {*own[a], *own[b]} if own[a].get(f) != own[b].get(f)]) == 1]
    return spark.createDataFrame(rows, "a string, b string, feature string")


def metric_closure() -> np.ndarray:
    """All-pairs shortest paths over the phone distances."""
    d = matrix().copy()
    for k in range(len(d)):
        np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :], out=d)
    return d


class DistanceModel:
    """Percentiles of similarity among a reference set of phones. Similarities are rounded, so that equal ones tie however they were
    added up."""

    def __init__(self, phoneset: list[str] | None = None, gamma: float = 1.0, given: dict[tuple[str, str], float] | None = None):
        own = [p for p in (phoneset or I.speech()) if p != I.SILENCE and (given is not None or p in I.phones())]
        self.phones, self.gamma, self.given = own, gamma, given
        self.cdf = sorted(round(1 - self.raw(a, b), 12) for a, b in itertools.combinations(own, 2))

    @classmethod
    def from_matrix(cls, table: DataFrame, gamma: float = 1.0) -> DistanceModel:
        """A model on a table (a, b, d) of an inventory's own distances, both directions averaged where both are there."""
        cell = {(r["a"], r["b"]): r["d"] for r in table.collect()}  # the square of an inventory, as read by load_matrix
        both = {(a, b): (d + cell.get((b, a), d)) / 2 for (a, b), d in cell.items()}
        return cls(sorted({a for a, _ in cell} | {b for _, b in cell}), gamma, both | {(b, a): d for (a, b), d in both.items()})

    def raw(self, a: str, b: str) -> float:
        """The distance that the percentiles are of; 1 where a given table has none."""
        return 0.0 if a == b else phone_distance(a, b) if self.given is None else self.given.get((a, b), 1.0)

    def confusability(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        d = self.raw(a, b)
        return 0.0 if d >= 1.0 or not self.cdf else (bisect_right(self.cdf, round(1 - d, 12)) / len(self.cdf)) ** self.gamma

    similarity = confusability

    def distance(self, a: str, b: str) -> float:
        return 1 - self.confusability(a, b)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, b, self.confusability(a, b)) for a in self.phones for b in self.phones], "a string, b string, confusability double")

    def nearest(self, spark: SparkSession, n: int = 5) -> DataFrame:
        """(a, b, confusability, rank): the n most confusable phones of each, ties by spelling."""
        w = Window.partitionBy("a").orderBy(F.desc("confusability"), "b")
        return self.table(spark).where("a <> b").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

    def sub_cost(self, a: str, b: str) -> float:
        """What a substitution costs: both gaps times the distance."""
        return 2 * GAP * self.distance(a, b)

    def sequence_distance(self, left: Column, right: Column, delete: float = GAP, insert: float = GAP) -> Column:
        """Edit cost of two arrays of units under this model, with prices of one's own for gaps; null if either is."""
        own = DistanceModel(self.phones, self.gamma, self.given)

        def cost(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(align_batch([None if x is None else list(x) for x in a], [None if x is None else list(x) for x in b], price=lambda x, y: (delete + insert) * own.distance(x, y), gaps=(delete, insert)))

        return F.nanvl(F.pandas_udf(cost, T.DoubleType())(left, right), F.lit(None))

    def word_distance(self, left: Column, right: Column) -> Column:
        return self.sequence_distance(X.units(left), X.units(right))

    def directional_word_distance(self, left: Column, right: Column, delete: float, insert: float) -> Column:
        return self.sequence_distance(X.units(left), X.units(right), delete, insert)

    def sequence_similarity(self, left: Column, right: Column) -> Column:
        total = F.size(left) + F.size(right)
        return F.when(total == 0, F.lit(1.0)).otherwise(1 - self.sequence_distance(left, right) / (total * GAP))

    def word_similarity(self, left: Column, right: Column) -> Column:
        return self.sequence_similarity(X.units(left), X.units(right))

    def rank_sequences(self, df: DataFrame, units_col: str, accepted: list[tuple[str, list[str]]], n: int = 1) -> DataFrame:
        """Each row of df with its n most similar ones of a list of (name, units), by this model's similarity; see rank_sequences."""
        own = DistanceModel(self.phones, self.gamma, self.given)
        return _ranked(df, F.col(units_col), [{"accepted": a, "u": u, "ordinal": k} for k, (a, u) in enumerate(accepted)], n, lambda x, y: 2 * GAP * own.distance(x, y))

    def is_similar(self, left: Column, right: Column, least: float) -> Column:
        """Whether words are similar enough; where their lengths alone rule it out, nothing is aligned."""
        n, m = F.size(X.units(left)), F.size(X.units(right))
        possible = 2 * F.least(n, m) >= least * (n + m)
        cost = self.sequence_distance(F.when(possible, X.units(left)), X.units(right))
        return F.when(left.isNull() | right.isNull(), None).when(n + m == 0, True).when(~possible, False).otherwise(1 - cost / (n + m) >= least)


# -- words ------------------------------------------------------------------------------------------------------------


def _prices(vocabulary: list[str], weighted: bool, price: Callable[[str, str], float] | None = None) -> np.ndarray:
    """Substitution costs of the distinct units of a batch: both gaps times their distance, unless a price is given."""
    if price:
        return np.array([[price(a, b) for b in vocabulary] for a in vocabulary]).reshape(len(vocabulary), len(vocabulary))
    n = len(vocabulary)
    out = np.full((n, n), 2 * GAP)
    for i in range(n):
        out[i, i] = 0
        if weighted:
            for j in range(i):
                out[i, j] = out[j, i] = 2 * GAP * phone_distance(vocabulary[i], vocabulary[j])
    return out


def align_batch(left: list[list[str]], right: list[list[str]], weighted: bool = True, mode: str = "global", price: Callable[[str, str], float] | None = None, gaps: tuple[float, float] = (GAP, GAP)) -> np.ndarray:
    """Costs of the cheapest alignments; local: the left one against any stretch of the right one. price: of a substitution; gaps:
    of a deleted and an inserted unit."""
    gone, new = gaps
    out = np.full(len(left), np.nan)
    vocabulary = sorted({u for s in (*left, *right) if s is not None for u in s})
    code = {u: i for i, u in enumerate(vocabulary)}
    table = _prices(vocabulary, weighted, price)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        if a is not None and b is not None:
            groups.setdefault((len(a), len(b)), []).append(k)
    for (n, m), rows in groups.items():
        a = np.array([[code[u] for u in left[k]] for k in rows], np.int64).reshape(len(rows), n)
        b = np.array([[code[u] for u in right[k]] for k in rows], np.int64).reshape(len(rows), m)
        before = np.tile(np.arange(m + 1) * (new if mode == "global" else 0.0), (len(rows), 1))
        for i in range(n):
            now = np.empty_like(before)
            now[:, 0] = (i + 1) * gone
            for j in range(m):
                now[:, j + 1] = np.minimum(np.minimum(before[:, j] + table[a[:, i], b[:, j]], before[:, j + 1] + gone), now[:, j] + new)
            before = now
        out[rows] = before[:, -1] if mode == "global" else before.min(1)
    return out


def sequence_distance(left: Column, right: Column, weighted: bool = True, mode: str = "global") -> Column:
    """Edit cost of two arrays of units; null if either is. Unweighted: the sum of the lengths less twice the longest common subsequence."""

    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(align_batch([None if x is None else list(x) for x in a], [None if x is None else list(x) for x in b], weighted, mode))

    return F.nanvl(F.pandas_udf(cost, T.DoubleType())(left, right), F.lit(None))


def sequence_similarity(left: Column, right: Column) -> Column:
    """1 less the cost of two arrays of units over that of deleting one and inserting the other; 1 for two empty ones."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - sequence_distance(left, right) / (total * GAP))


def unit_distance(left: Column, right: Column) -> Column:
    """Distance of two written units; null if either is."""
    return F.pandas_udf(lambda a, b: pd.Series([None if x is None or y is None else phone_distance(x, y) for x, y in zip(a, b, strict=True)], dtype=float), T.DoubleType())(left, right)


def word_distance(left: Column, right: Column, weighted: bool = True) -> Column:
    return sequence_distance(X.units(left), X.units(right), weighted)


def word_similarity(left: Column, right: Column) -> Column:
    """1 less the cost over that of deleting one side and inserting the other; 1 for two empty words."""
    total = F.size(X.units(left)) + F.size(X.units(right))
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - word_distance(left, right) / (total * GAP))


def coverage(left: Column, right: Column) -> Column:
    n, m = F.size(X.units(left)), F.size(X.units(right))
    return F.when(F.greatest(n, m) == 0, F.lit(1.0)).otherwise(F.least(n, m) / F.greatest(n, m))


def similar_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, least: float) -> DataFrame:
    """Pairs of words that begin alike (equal first unit) and are similar enough.

    The join is on the first unit and the length of the right word: a word of n units is only sent to lengths m for which
    2 * min(n, m) / (n + m), which bounds the similarity, is enough. So first units, of which there are few, aren't the keys alone.
    """
    l, k, n, r, k2, m, s = (_two(left, right, x) for x in ("__l", "__k", "__n", "__r", "__k2", "__m", "similarity"))  # noqa: E741
    a = left.withColumn(l, X.units(F.col(left_col))).withColumn(k, F.element_at(l, 1)).where(F.size(l) > 0)
    reach = F.sequence(F.ceil(F.size(l) * least / (2 - least)).cast("int"), F.floor(F.size(l) * (2 - least) / least).cast("int"))
    a = a.withColumn(n, F.explode(reach))
    b = right.withColumn(r, X.units(F.col(right_col))).withColumn(k2, F.element_at(r, 1)).withColumn(m, F.size(r))
    pairs = a.join(b, (F.col(k) == F.col(k2)) & (F.col(n) == F.col(m)))
    scored = pairs.withColumn(s, 1 - sequence_distance(F.col(l), F.col(r)) / (F.size(l) + F.size(r)))
    return scored.where(F.col(s) >= least).drop(l, r, k, k2, n, m)


def _two(left: DataFrame, right: DataFrame, name: str) -> str:
    return X.free(right, X.free(left, name))


def rank_pronunciations(df: DataFrame, form_col: str, accepted: DataFrame, accepted_col: str, n: int = 1) -> DataFrame:
    """Each row of df with its n most similar accepted pronunciations; ties by their listing (column ordinal).

    accepted is a list that a user writes; it is checked to have at most 10,000 rows and sent along as a literal. Each form is
    aligned with all of it in one batch, and only its n best leave the task: no pairs are made as rows, and nothing is shuffled.
    """
    listing = accepted.select(F.col(accepted_col).alias("accepted"), "ordinal").limit(10_001).collect()
    if len(listing) > 10_000:
        raise ValueError("rank against a list of at most 10,000 pronunciations, or use similar_join")
    return _ranked(df, X.units(F.col(form_col)), accepted.select(F.col(accepted_col).alias("accepted"), X.units(F.col(accepted_col)).alias("u"), "ordinal").limit(10_000).collect(), n)


def rank_sequences(df: DataFrame, units_col: str, accepted: list[tuple[str, list[str]]], n: int = 1) -> DataFrame:
    """The same for arrays of units and a list of (name, units)."""
    return _ranked(df, F.col(units_col), [{"accepted": a, "u": u, "ordinal": k} for k, (a, u) in enumerate(accepted)], n)


def _ranked(df: DataFrame, units: Column, listing: list, n: int, price: Callable[[str, str], float] | None = None) -> DataFrame:
    """price: of a substitution, in place of the metric's."""
    own = sorted(((r["accepted"], list(r["u"]), r["ordinal"]) for r in listing if r["u"] is not None), key=lambda r: r[2])
    best = T.ArrayType(T.StructType([T.StructField("accepted", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType())]))

    def rank(forms: pd.Series) -> pd.Series:
        given = [[] if u is None else list(u) for u in forms]
        out = [[] for _ in given]
        lengths = np.array([len(v) for _, v, _ in own], float)
        # forms of a batch are aligned together, some at a time, so that memory holds no more than ALIGNED pairs
        some = max(1, ALIGNED // max(len(own), 1))
        for lo in range(0, len(given) if own else 0, some):
            part = given[lo : lo + some]
            cost = align_batch([u for u in part for _ in own], [v for _ in part for _, v, _ in own], **({"price": price, "gaps": (GAP, GAP)} if price else {})).reshape(len(part), len(own))
            total = np.array([[len(u)] for u in part], float) + lengths
            score = np.where(total == 0, 1.0, 1 - cost / np.maximum(total * GAP, 1e-9))
            order = np.argsort(-score, axis=1, kind="stable")[:, :n]
            for k, best in enumerate(order):
                out[lo + k] = [{"accepted": own[i][0], "ordinal": int(own[i][2]), "similarity": float(score[k, i]), "rank": r + 1} for r, i in enumerate(best)]
        return pd.Series([[] if u is None else x for u, x in zip(forms, out, strict=True)])

    best_col = X.free(df, "__best")
    return df.withColumn(best_col, F.explode(F.pandas_udf(rank, best)(units))).select(*df.columns, f"{best_col}.*")


def explain_word_distance(a: list[str], b: list[str]) -> list[tuple[str, str | None, str | None, float]]:
    """Steps (op, left, right, cost) of the cheapest alignment; back from the end, diagonal before delete before insert."""
    n, m = len(a), len(b)
    sub = [[2 * GAP * phone_distance(x, y) for y in b] for x in a]
    d = [[j * GAP for j in range(m + 1)]]
    for i in range(1, n + 1):
        before, row = d[-1], [i * GAP]
        for j in range(1, m + 1):
            row.append(min(before[j - 1] + sub[i - 1][j - 1], before[j] + GAP, row[j - 1] + GAP))
        d.append(row)
    # as np.isclose, which takes long for single numbers
    same = lambda x, y: abs(x - y) <= 1e-8 + 1e-5 * abs(y)
    out, i, j = [], n, m
    while i or j:
        if i and j and same(d[i][j], d[i - 1][j - 1] + sub[i - 1][j - 1]):
            out.append(("match" if a[i - 1] == b[j - 1] else "sub", a[i - 1], b[j - 1], float(sub[i - 1][j - 1])))
            i, j = i - 1, j - 1
        elif i and same(d[i][j], d[i - 1][j] + GAP):
            out.append(("delete", a[i - 1], None, GAP))
            i -= 1
        else:
            out.append(("insert", None, b[j - 1], GAP))
            j -= 1
    return out[::-1]
