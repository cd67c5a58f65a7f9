"""Licensed syllables and their readings."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lautwerk.functions import text as X
from lautwerk.operators import find
from lautwerk.operators import syllables as S
from lautwerk.plans.terms import QueryError

TOY = S.Language("toy", onsets=("[-vowel]", "[obstruent] [manner=trill]", "s [plosive]"), codas=("[nasal]", "s", "[nasal] s"))


def divided(spark, form, language, plain=False):
    with X.plain(plain):
        r = spark.createDataFrame([(form,)], "f string").select(S.syllabify(F.col("f"), language).alias("x")).first()["x"]
    return None if r is None else ([s["text"] for s in r["syllables"]], [s["text"] for s in r["residue"]])


@pytest.mark.parametrize(
    "form, language, want",
    [
        ("abrasa", S.SPANISH, (["a", "bra", "sa"], [])),
        ("trans", S.SPANISH, (["trans"], [])),
        ("strata", S.SPANISH, (["tra", "ta"], ["s"])),
        ("aista", S.SPANISH, (["a", "is", "ta"], [])),
        ("strata", TOY, (["tra", "ta"], ["s"])),
        ("stata", TOY, (["sta", "ta"], [])),
        ("tatak", TOY, (["ta", "ta"], ["k"])),
        ("tansk#mat", TOY, (["tans", "ma"], ["k", "t"])),
        ("ˈtʰa.ta", TOY, (["ˈtʰa", "ta"], [])),
        ("tk", TOY, ([], ["tk"])),
        ("", TOY, ([], [])),
        (None, TOY, None),
    ],
)
def test_syllables(spark, form, language, want):
    assert divided(spark, form, language) == want


def test_readings_agree_with_a_search(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("staaeinrk") for _ in range(draw.randrange(1, 10))) for _ in range(300)]
    onset, coda = re.compile("(?:[tsnrk]|[tsk]r|s[tk])?"), re.compile("(?:n|s|ns)?")

    def plain(w):
        runs = re.split("[aei]", w)
        if len(runs) < 2 or not onset.fullmatch(runs[0]) or not coda.fullmatch(runs[-1]):
            return []
        ways = [[k for k in range(len(r) + 1) if coda.fullmatch(r[:k]) and onset.fullmatch(r[k:])] for r in runs[1:-1]]
        return [list(x) for x in itertools.product(*ways)]

    df = spark.createDataFrame([(w,) for w in words], "f string")
    for on in (True, False):
        with X.plain(on):
            got = df.select("f", S.count_readings(F.col("f"), TOY).alias("n"), S.readings(F.col("f"), TOY).alias("all")).collect()
        assert all(r["n"] == len(plain(r["f"])) and r["all"] == plain(r["f"]) for r in got)


def test_languages_from_a_table(spark):
    rows = [("toy", "onset", 1, "[-vowel]", None), ("toy", "onset", 2, "s [plosive]", "borrowing"), ("toy", "coda", 1, "[nasal]", "native")]
    kind = "language string, kind string, ordinal int, span string, stratum string"
    toy = S.read_languages(spark.createDataFrame(rows, kind))["toy"]
    assert toy.onsets == ("[-vowel]", "s [plosive]") and toy.strict().onsets == ("[-vowel]",)
    assert divided(spark, "stan", toy) == (["stan"], []) and divided(spark, "stan", toy.strict()) == (["tan"], ["s"])
    for bad in (("toy", "margin", 1, "[-vowel]", None), ("toy", "onset", 1, "[-vowel]", "foreign")):
        with pytest.raises(QueryError):
            S.read_languages(spark.createDataFrame([bad], kind))


def test_tiers_feed_patterns(spark):
    df = spark.createDataFrame([("tansta#ta",)], "f string").withColumn("t", S.tiers(F.col("f")))
    hits = lambda spec: [(r["pos"], r["unit"]) for r in find.find(df, "f", spec, tiers_col="t").collect()]
    assert hits("[-vowel] / _ syllable>") == [(3, "s")]
    assert hits("t / <word _") == [(0, "t"), (6, "t")] and hits("a / _ word>") == [(5, "a"), (7, "a")]
