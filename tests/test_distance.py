"""Distances against published values, and alignment against a plain dynamic program."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lautwerk.operators import analysis, distance


@pytest.mark.parametrize("a, b, d", [("p", "b", 0.05), ("p", "k", 0.0675), ("p", "a", 0.33772727), ("f", "θ", 0.0115), ("d", "ɡ", 0.0480), ("f", "n", 0.1432), ("ʃ", "n", 0.1607), ("ʃ", "b", 0.1302), ("t", "tʰ", 0.0476), ("ʃ", "m", 0.1802), ("s", "ɡ", 0.1497), ("ɡ", "ʒ", 0.0907)])
def test_published(a, b, d):
    assert distance.phone_distance(a, b) == pytest.approx(d, abs=6e-5)
    assert distance.phone_distance(a, b) == distance.phone_distance(b, a)


@pytest.mark.parametrize("a, b, d", [("t͡s", "t", 0.2629), ("t͡ʃ", "ʃ", 0.2652), ("t͡ʃ", "t͡s", 0.0030), ("u͡i", "u͜i", 1 / 3), ("e", "e͜ɪ", 0.255), ("ɡ", "ɡ͡b", 1 / 20 + 0.0675 / 2), ("k͡p", "p͡k", 0), ("t", "t̪", 0.005), ("t", "tʷ", 0.002)])
def test_published_of_several_parts(a, b, d):
    assert distance.phone_distance(a, b) == pytest.approx(d, abs=6e-4 if d in (0.255, 0.005, 0.002) else 6e-5)
    assert distance.phone_distance(a, b) == distance.phone_distance(b, a)


def test_prosody_rides_on_units():
    n = len(distance.segment_terms("a", "a"))
    assert distance.phone_distance("ˈa", "a") == pytest.approx(1 / (n + 1)) and distance.phone_distance("ˈa", "ˌa") == pytest.approx(0.5 / (n + 1))
    assert distance.phone_distance("a˥", "a") == pytest.approx(1 / (n + 1)) and distance.phone_distance("aː", "aˑ") < distance.phone_distance("aː", "a")
    # a rhotic vowel has no one place, so that term is left out
    assert "tract-x" not in dict(distance.segment_terms("ɚ", "i")) and "tract-x" in dict(distance.segment_terms("ə", "i"))


def test_identity_and_sentinels():
    assert distance.phone_distance("Q?", "Q?") == 0 and distance.phone_distance("p", "7") == 1 and distance.phone_distance("p", "␣") == 1


def test_closure_is_a_metric():
    c, m = distance.metric_closure(), distance.matrix()
    assert (c <= m + 1e-12).all() and (c[:, None, :] <= c[:, :, None] + c[None, :, :] + 1e-9).all()


def plain(a, b, price):
    d = [[i + j if not i * j else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j - 1] + price(a[i - 1], b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return d[-1][-1]


def test_alignment():
    rng = np.random.default_rng(2)
    words = [[str(c) for c in rng.choice(list("ptkaeisn"), rng.integers(0, 7))] for _ in range(60)]
    left, right = words[:30] + [None], words[30:] + [["a"]]
    for weighted in (True, False):
        got = distance.align_batch(left, right, weighted)
        for k in range(30):
            price = (lambda x, y: 2 * distance.phone_distance(x, y)) if weighted else (lambda x, y: 0 if x == y else 2)
            assert got[k] == pytest.approx(plain(left[k], right[k], price))
        assert np.isnan(got[30])
    assert distance.align_batch([["t", "a"]], [["s", "t", "a", "n"]], True, "local")[0] == 0


def test_explain():
    steps = distance.explain_word_distance(list("tan"), list("tat͡s".replace("t͡s", "d")))
    assert [s[0] for s in steps] == ["match", "match", "sub"]
    assert sum(s[3] for s in steps) == pytest.approx(distance.align_batch([list("tan")], [list("tad")])[0])


def test_columns(spark):
    df = spark.createDataFrame([("tan", "dan"), ("", ""), (None, "a")], "a string, b string")
    r = df.select(distance.word_similarity(F.col("a"), F.col("b")).alias("s"), distance.coverage(F.col("a"), F.col("b")).alias("c")).collect()
    assert r[0]["s"] == pytest.approx(1 - 0.1 / 6) and r[1]["s"] == 1 and r[2]["s"] is None


def test_similar_join(spark):
    a = spark.createDataFrame([("tan",), ("tad",), ("kan",)], "a string")
    b = spark.createDataFrame([("tan",), ("tananan",)], "b string")
    got = {(r["a"], r["b"]) for r in distance.similar_join(a, b, "a", "b", 0.9).collect()}
    assert got == {("tan", "tan"), ("tad", "tan")}


def test_rank(spark):
    accepted = spark.createDataFrame([("tan", 0), ("dan", 1), ("tan", 2)], "p string, ordinal int")
    r = distance.rank_pronunciations(spark.createDataFrame([("tan",)], "f string"), "f", accepted, "p", n=3).orderBy("rank").collect()
    assert [(x["accepted"], x["ordinal"]) for x in r] == [("tan", 0), ("tan", 2), ("dan", 1)]


def test_model():
    m = distance.DistanceModel(["p", "b", "t", "a"])
    assert m.confusability("p", "p") == 1 and m.confusability("p", "7") == 0
    assert m.confusability("p", "b") > m.confusability("p", "a") and m.distance("p", "b") == 1 - m.confusability("p", "b")


def test_natural_class_and_hierarchy():
    assert analysis.natural_class(["p", "t", "k"], False) == {"manner": "plosive", "voiced": "-"}
    assert analysis.natural_class(["m", "n", "ŋ"], False) == {"manner": "nasal", "voiced": "+"}
    tree = analysis.hierarchy(["p", "b", "a"])
    assert tree[0][1] == "manner=plosive" and {"p", "b"} <= set(tree[0][2])


def test_nearest(spark):
    near = {r["a"]: r["b"] for r in distance.nearest_phones(spark, 1).collect()}
    assert near["f"] == "ɸ" and len(near) == 138


def test_model_ranks_by_its_own_similarity(spark):
    m = distance.DistanceModel(["p", "b", "t", "a", "s", "i"])
    listed = [("pa", ["p", "a"]), ("sa", ["s", "a"]), ("ti", ["t", "i"]), ("none", [])]
    rows = spark.createDataFrame([(["b", "a"],), (["t", "a"],), ([],), (None,)], "u array<string>")
    got = m.rank_sequences(rows, "u", listed, 4).collect()
    for u in (["b", "a"], ["t", "a"]):
        frame = spark.createDataFrame([(u, x, name) for name, x in listed], "a array<string>, b array<string>, name string")
        want = {r["name"]: r["s"] for r in frame.select("name", m.sequence_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
        own = [(r["accepted"], r["similarity"]) for r in sorted(got, key=lambda r: r["rank"]) if r["u"] == u]
        assert [s for _, s in own] == pytest.approx(sorted(want.values(), reverse=True)) and {n: pytest.approx(s) for n, s in own} == want
    assert {r["u"] is None for r in got} == {False}
