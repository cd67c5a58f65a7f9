"""Sites without bounds, tiers, units of several parts, boundary runs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lautwerk.functions import text as X
from lautwerk.operators import find, rewrite
from lautwerk.plans.terms import QueryError


def hits(spark, form, spec, plain=False, tiers=None):
    kind = "form string, tiers array<struct<tier:string,start:int,end:int>>"
    df = spark.createDataFrame([(form, tiers or [])], kind)
    return [(r["pos"], r["unit"]) for r in find.find(df, "form", spec, plain=plain, tiers_col="tiers").orderBy("pos").collect()]


def apply(spark, form, rules):
    return spark.createDataFrame([(form,)], "form string").select(rewrite.rewrite(F.col("form"), rules)).first()[0]


@pytest.mark.parametrize("plain", [True, False])
def test_spans_have_no_bound(spark, plain):
    for n in (0, 64, 65, 300, 3000):
        assert hits(spark, "s" + "k" * n + "t", "t / s ([-vowel])* _", plain) == [(n + 1, "t")]
        assert hits(spark, "t" + "k" * n + "s", "t / _ ([-vowel])* s", plain) == [(0, "t")]
        assert hits(spark, "s" + "k" * n + "at", "t / s ([-vowel])* _", plain) == []
        assert hits(spark, "s" + "k" * n + "t", "t / s (k){0,65} _", plain) == ([(n + 1, "t")] if n <= 65 else [])
        assert hits(spark, "s" + "k" * n + "t", "t / s (k){65,} _", plain) == ([(n + 1, "t")] if n >= 65 else [])
    with X.plain(plain):
        long = "s" + "k" * 500 + "t"
        got = spark.createDataFrame([(long,)], "f string").select(rewrite.rewrite(F.col("f"), "t -> d / s (k)* _"), find.offsets(F.col("f"), "t / s (k)* _")).first()
        assert got[0] == long[:-1] + "d" and got[1] == [501]


def test_spans_agree_with_a_search(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("staikn") for _ in range(draw.randrange(1, 14))) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in words], "form string")
    for spec, left, right in (("t / s ([-vowel])* _", "s[^ai]*$", ""), ("t / s ([vowel])+ _ (n)? a", "s[ai]+$", "^n?a"), ("[vowel] / _ ([-vowel])* #", "", "^[^ai]*$"), ("n / # (t)? ([vowel]){2,3} _", "^t?[ai]{2,3}$", "")):
        target = "[ai]" if spec[0] == "[" else spec[0]
        want = {(w, k) for w in words for k in range(len(w)) if re.match(target, w[k]) and re.search(left, w[:k]) and re.search(right, w[k + 1 :])}
        for plain in (True, False):
            assert {(r["form"], r["pos"]) for r in find.find(df, "form", spec, plain=plain).collect()} == want, spec


def test_units_with_many_marks(spark):
    many = "a" + "".join(["\u0330", "\u0324", "\u0325", "\u0308", "\u031a", "\u033d", "\u031e", "\u0303"])
    assert hits(spark, f"t{many}t", "t / [+nasalized] _") == [(2, "t")]
    assert hits(spark, f"t{many}t", "[vowel +nasalized]") == [(1, many)]
    assert hits(spark, "ˈˌˈat", "t / [vowel stress=primary] _") == [(1, "t")] and hits(spark, "ˈˌat", "t / [vowel stress=primary] _") == []
    assert apply(spark, f"{many}t", "t -> d / [+nasalized] _") == f"{many}d"


def test_units_of_several_parts_have_their_flat_bundle(spark):
    assert hits(spark, "k͡xak", "[affricate]") == [(0, "k͡x")]
    assert hits(spark, "k͡xak", "[plosive]") == [(2, "k")]
    assert hits(spark, "ak͡x͡xa", "a / [affricate] _") in ([(2, "a")], [])  # by the algebra
    assert hits(spark, "ˈk͡xat", "[affricate stress=primary]") == [(0, "ˈk͡x")] and hits(spark, "k͡xat", "[affricate stress=primary]") == []
    assert hits(spark, "k͡xːa", "[length=long]") == [(0, "k͡xː")] and hits(spark, "k͡xa", "[affricate length=normal]") == [(0, "k͡x")]
    assert apply(spark, "k͡xk", "k -> ɡ") == "k͡xɡ"


def test_tiers_name_edges(spark):
    # a.ta: syllables a, ta; a word over both
    tiers = [("syllable", 0, 1), ("syllable", 1, 3), ("word", 0, 3)]
    assert hits(spark, "ata", "t / <syllable _", tiers=tiers) == [(1, "t")]
    assert hits(spark, "ata", "a / _ syllable>", tiers=tiers) == [(0, "a"), (2, "a")]
    assert hits(spark, "ata", "a / _ word>", tiers=tiers) == [(2, "a")]
    assert hits(spark, "ata", "a / <word <syllable _ syllable>", tiers=tiers) == [(0, "a")]
    assert hits(spark, "ata", "t / [vowel] syllable> <syllable _ [vowel]", tiers=tiers) == [(1, "t")]
    assert hits(spark, "a.ta", "t / [vowel] <syllable _", tiers=tiers) == [(1, "t")]
    assert hits(spark, "ata", "t / <mora _", tiers=tiers) == []
    for bad in ("<mora", "t / <mora> _", "t / <melody _"):
        with pytest.raises(QueryError):
            hits(spark, "a", bad)
    with pytest.raises(QueryError, match="needs intervals"):
        find.sites(F.col("form"), "t / <syllable _")


@pytest.mark.parametrize(
    "form, rules, want",
    [
        ("a..b", ". -> #", "a#b"),
        ("a.s", "∅ -> e / [vowel] _ s", "ae.s"),
        ("a.s", "∅ -> e / . _ s", "a.es"),
        ("#tæt#", "∅ -> ə / # _", "#ətæt#"),
        ("tæt", "∅ -> ə / # _", "ətæt"),
        ("tat.", "∅ -> ə / t _ #", "tatə."),
        ("a‿t", "‿ -> ∅", "at"),
        ("at#.ta", "t -> d / _ #", "ad#.ta"),
        ("ta#ta", "t -> d / # _", "da#da"),
        ("ta ta", "t -> d / # _", "da da"),
        ("t7t", "t -> d / t _", "t7t"),
    ],
)
def test_boundaries_in_rules(spark, form, rules, want):
    assert apply(spark, form, rules) == want


def test_queries_as_rules_and_symbols_off_the_chart(spark):
    from lautwerk import inventory as I
    from lautwerk.plans import patterns as P

    rule = P.query_rule("t / [vowel] _ [vowel]", "ɾ")
    assert spark.createDataFrame([("atata",)], "form string").select(rewrite.rewrite(F.col("form"), [rule])).first()[0] == "aɾaɾa"
    with pytest.raises(QueryError):
        P.query_rule("t a", "ɾ")
    rows = [("#kæt#", "##"), ("a␣b", "␣"), ("le∅ʃ", "∅"), ("ˈkæt.dɒɡ", ""), ("xyz$", ""), ("lez‿ami", "")]
    got = spark.createDataFrame(rows, "f string, want string").select("want", F.array_join(X.extensions_in(F.col("f")), "").alias("e"), X.is_pure(F.col("f")).alias("p")).collect()
    assert all(r["e"] == r["want"] and r["p"] == (r["want"] == "") for r in got)
    assert I.notation_of("Q") == I.notation_of("a") == I.CHART != I.notation_of("#")
