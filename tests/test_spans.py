"""Boundaries, their levels, and stress signatures."""

from pyspark.sql import functions as F

from lautwerk.operators import intervals as V


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(column(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first()[0]


def test_read(spark):
    r = V.read_forms(spark.createDataFrame([("ˈa.t#aX",)], "f string"), "f").first()
    assert r["units"] == ["ˈa", "t", "a"] and [tuple(b) for b in r["boundaries"]] == [(1, "."), (2, "#")]
    assert [tuple(p) for p in r["prosody"]] == [(0, "ˈ")] and r["lost"] == ["X"]


def test_levels(spark):
    assert [tuple(b) for b in one(spark, V.boundary_levels, "a.t‖a")] == [(1, "syllable"), (2, "utterance")]
    spans = one(spark, lambda f: V.spans_of_level(f, "word"), "a.t#a‖tt")
    assert [(s["start"], s["end"]) for s in spans] == [(0, 2), (2, 3), (3, 5)]
    assert one(spark, lambda f: V.edges_on(f, "syllable"), "a.t#a") == [0, 1, 2]


def test_signatures(spark):
    assert one(spark, V.stress_signature, "tˈatəmˌi") == "102"
    assert one(spark, V.apply_signature, "tatəmi", "102") == "tˈatəmˌi"
    assert one(spark, V.apply_signature, "tˈa.ta", "01") == "ta.tˈa"
    assert one(spark, V.apply_signature, "tata", "1") is None
