"""Nearest forms, tracks, built graphs, rendered trees, composed vocabularies."""

import random

import pytest
from pyspark.sql import functions as F

from lautwerk.functions import transducer
from lautwerk.operators import build, compare, nearest, order, render, tracks


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("other", [True, False])
def test_nearest_agrees_with_all_pairs(spark, other):
    draw = random.Random(8)
    words = sorted({"".join(draw.choice("abcd") for _ in range(draw.randrange(0, 12))) for _ in range(300)} | {"z" * 30})
    df = spark.createDataFrame([(w,) for w in words + words[:5]] + [(None,)], "w string")
    asked = words[::7] + ["", "z" * 30, "dddddddddddd"]
    got = {r["form"]: (r["distance"], r["nearest"]) for r in nearest.nearest(spark.createDataFrame([(w,) for w in asked], "q string"), "q", df, "w", other=other).collect()}
    assert got == {q: min((levenshtein(q, w), w) for w in words if not other or w != q) for q in asked}


def test_nearest_in_short_lists(spark):
    one = spark.createDataFrame([("a",)], "w string")
    assert nearest.nearest(one, "w", one, "w").count() == 0
    assert [tuple(r) for r in nearest.nearest(one, "w", one, "w", other=False).collect()] == [("a", "a", 0)]
    two = spark.createDataFrame([("a",), ("bcd",)], "w string")
    assert {tuple(r) for r in nearest.nearest(two, "w", two, "w").collect()} == {("a", "bcd", 3), ("bcd", "a", 3)}


def test_only_far_forms_go_through_pivots(spark, monkeypatch):
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("abcdefgh") for _ in range(8)) for _ in range(400)} | {"é" * 7, "é" * 9, "z" * 40})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    asked, through = words[::5] + ["é" * 9, "z" * 40], []
    pivots = nearest._by_pivots
    monkeypatch.setattr(nearest, "_by_pivots", lambda rest, *a: through.extend(r["q"] for r in rest.collect()) or pivots(rest, *a))
    got = {r["form"]: (r["distance"], r["nearest"]) for r in nearest.nearest(spark.createDataFrame([(w,) for w in asked], "q string"), "q", df, "w").collect()}
    want = {q: min((levenshtein(q, w), w) for w in words if w != q) for q in asked}
    assert got == want
    assert set(through) == {q for q in asked if want[q][0] > nearest.BY_PARTS} and "z" * 40 in through


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_resampled_tracks(spark, width):
    draw = random.Random(width)
    samples = [(k, draw.randrange(-50, 200), float(draw.randrange(9))) for k in (1, 2) for _ in range(40)] + [(3, 5, 1.0), (4, None, 2.0), (4, 7, None)]
    asked = [(k, t) for k in (1, 2, 3, 4, 5) for t in range(-60, 210, 9)]
    got = {(r["track"], r["t"]): r["value"] for r in tracks.resample(spark.createDataFrame(samples, "track int, t long, value double"), spark.createDataFrame(asked, "track int, t long"), width).collect()}
    for k, t in asked:
        own = {}
        for j, at, v in samples:
            if j == k and at is not None and v is not None:
                own[at] = max(own.get(at, v), v)
        lo, hi = max((x for x in own if x <= t), default=None), min((x for x in own if x >= t), default=None)
        want = None if not own else own[hi] if lo is None else own[lo] if hi is None or lo == hi else own[lo] + (own[hi] - own[lo]) * (t - lo) / (hi - lo)
        assert got[k, t] == (want if want is None else pytest.approx(want))


def test_spans_and_names(spark):
    rows = [(1, 1, "b", 0), (1, 2, "e", 1), (1, 3, "e", 2), (1, 4, "b", 3), (1, 5, "b", 4), (1, 5, "e", 5), (1, 9, "b", 6), (2, 1, "x", 7), (2, 2, "e", 8)]
    df = spark.createDataFrame(rows, "u int, t int, kind string, k int")
    found, rest = build.spans(df, ["u"], "t", "kind", "b", "e", "k")
    assert {tuple(r) for r in found.collect()} == {(1, 1, 2), (1, 5, 5)}
    assert {tuple(r) for r in rest.collect()} == {(1, 4, "unfinished"), (1, 9, "unfinished"), (1, 3, "stray"), (2, 2, "stray")}
    once, again = build.nodes(found, "s", ["u", "start"]), build.nodes(found.repartition(5), "s", ["u", "start"])
    assert build.merge(once, again).count() == 2
    ids = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("-", "abc")], "x string, y string").select(build.identity("t", F.col("x"), F.col("y")).alias("i"))
    assert ids.distinct().count() == 4
    rel = build.relation(df, F.lit(1), "has", F.col("u"), F.col("k"), F.col("t")).orderBy("src", "ordinal").collect()
    assert [(r["src"], r["ordinal"], r["tgt"]) for r in rel][:3] == [(1, 0, 0), (1, 1, 1), (1, 2, 2)]


def test_rendered_forms(spark):
    forms = [(1, "ta.na#ba"), (2, "ˈtʰa"), (3, ""), (4, "a#t͡sa.ta.ta#a")]
    df = spark.createDataFrame(forms, "id int, f string")
    tree, nodes = compare.tree(df, "id", "f"), render.labels(df, "id", "f")
    kind = "tier string, before string, between string, after string"
    plain = spark.createDataFrame([("utterance", "", "#", ""), ("word", "", ".", "")], kind)
    assert {r["graph"]: r["text"] for r in render.render(tree, nodes, plain).collect()} == {str(i): f for i, f in forms}
    brackets = spark.createDataFrame([("word", "[", "", "]"), ("syllable", "(", "", ")"), ("word", "[", "", "]")], kind)
    assert {r["graph"]: r["text"] for r in render.render(tree, nodes, brackets).collect()}["1"] == "[(ta)(na)][(ba)]"


def test_composed_vocabularies(spark):
    v = transducer.compose({"a": "A", "b": "B", "t͡ʃ": "CH", "t": "T", "h": "H"}, {"ʧ": "c", "c": "t͡ʃ"}, {"b": "t", "t": "h"}, ())
    one = lambda c, f: spark.createDataFrame([(f,)], "f string").select(c(F.col("f")).alias("x")).first()["x"]
    got = one(v.map, "ʧab t?")
    assert got["symbols"] == ["CH", "A", "H", "H"] and got["refused"] == ["?"]
    assert transducer.compose({"a": "A", "h": "H"}, {}, {"a": "h"}, ("h",)).table == {"a": "", "h": ""}
    for bad in (dict(aliases={"x": "y", "y": "x"}), dict(aliases={"x": "z"}), dict(reductions={"a": "b", "b": "a"}), dict(reductions={"z": "a"})):
        with pytest.raises(transducer.VocabularyError):
            transducer.compose({"a": "A", "b": "B"}, **bad)


def test_small_trees_are_rendered_whole(spark, monkeypatch):
    draw = random.Random(2)
    edges = [(f"g{g}", "contains", f"n{draw.randrange(9)}", draw.randrange(3), f"n{draw.randrange(9)}") for g in range(40) for _ in range(draw.randrange(1, 9))]
    edges += [(f"t{g}", "contains", f"n{k}", draw.randrange(3), f"n{draw.randrange(k + 1, 9)}") for g in range(40) for k in range(8)] + [("g1", "other", "n0", 0, "n1")]
    nodes = [(g, f"n{k}", draw.choice("abc"), draw.choice(["x", "y", None])) for g in sorted({e[0] for e in edges} | {"none"}) for k in range(9) if draw.random() < 0.9]
    nodes += nodes[::17] + [("lone", "n0", "a", "z")]
    rel = spark.createDataFrame(edges + edges[::11], "graph string, name string, src string, ordinal int, tgt string")
    own = spark.createDataFrame(nodes, "graph string, node string, tier string, text string")
    profile = spark.createDataFrame([("a", "[", ",", "]"), ("b", None, "-", None)], "tier string, before string, between string, after string")
    told = lambda: sorted(tuple(r) for r in render.render(rel, own, profile).collect())
    rounds = render._by_rounds
    monkeypatch.setattr(render, "_by_rounds", None)
    whole = told()
    monkeypatch.setattr(render, "_by_rounds", rounds)
    monkeypatch.setattr(order, "SMALL", 0)
    assert whole == told() and len(whole) > 80 and ("lone", "n0", "[z]") in whole
