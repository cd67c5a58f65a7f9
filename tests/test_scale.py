"""Steps whose cost must not grow with the square of a form, or land in one task."""

import re
import time

from pyspark.sql import functions as F

from lautwerk import workload
from lautwerk.functions import text as X
from lautwerk.operators import find


def test_open_spans_in_long_forms(spark):
    """One form of 60,000 units without the first unit of the context, and one with it; the targets don't each look back over all of it."""
    n = 30_000
    df = spark.createDataFrame([("az" * n,), ("q" + "az" * n,), ("zq.a.zz" + "az" * 150 + "qz",), (None,)], "form string")
    with X.plain():
        spans = {"*": [0, n, 153, 0], "{200,}": [0, n - 100, 52, 0]}
        began = time.time()
        for high, want in spans.items():
            spec = f"z / q ([-uvular]){high} _"
            rows = df.select(find.count(F.col("form"), spec).alias("n")).collect()
            assert [r["n"] for r in rows] == want
        assert time.time() - began < 30
        short = df.where("length(form) < 1000")
        spec = "z / q ([-uvular])* _"
        got = short.select(find.sites(F.col("form"), spec).alias("s")).first()["s"]
    assert [x["pos"] for x in got][:4] == [3, 4, 6, 8] and got[-1]["pos"] == 306 and {x["unit"] for x in got} == {"z"}


def test_part_names_are_dealt_out(spark, sf):
    for name in ("word_edges", "query_as_rule", "off_chart"):
        assert workload.queries()[name](spark, sf).rdd.getNumPartitions() == 4, name


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wire_text_is_read_once(spark, sf):
    assert _plan(workload.queries()["json_round_trip"](spark, sf)).count("from_json") == 1


def test_variants_are_made_once(spark, sf):
    """No filter asks for their number before they are listed."""
    assert re.search(r"Generate explode\(variants#\d+\), \[1\], true", _plan(workload.queries()["variant_forms"](spark, sf)))


def test_classes_hold_ranges():
    """Every symbol by itself is asked for one after another, for each character of a text."""
    assert X.ranges("cab-^xŋ") == "\\-\\^a-" + "cxŋ"
    assert len(X.base_class()) < len(X.atoms())


def test_words_of_a_batch_are_ranked_together(spark):
    from lautwerk.operators import distance

    listing = spark.createDataFrame([("ðə", 0), ("ænd", 1), ("ðə", 2)], "accepted string, ordinal int")
    forms = spark.createDataFrame([(f,) for f in ["ðə", "ænt", "", None, "ə"]], "form string")
    got = {r["form"]: (r["accepted"], r["ordinal"], r["rank"]) for r in distance.rank_pronunciations(forms, "form", listing, "accepted").collect()}
    assert got == {"ðə": ("ðə", 0, 1), "ænt": ("ænd", 1, 1), "": ("ðə", 0, 1), "ə": ("ðə", 0, 1)}
    assert distance.ALIGNED >= 10_000


def test_rings_are_followed_once(spark, monkeypatch):
    """A ring needs no colours, nor does one beside what has forks; a way that leads to a ring isn't on it."""
    from lautwerk.operators import order

    rows = [(1, "contains", f"r{k}", 0, f"r{(k + 1) % 50}") for k in range(50)] + [(2, "contains", a, 0, b) for a, b in ("ab", "ba", "bc", "cb", "xa", "yy")]
    rel = spark.createDataFrame(rows, "graph int, name string, src string, ordinal int, tgt string")
    want = {(1, f"r{k}", "r0") for k in range(50)} | {(2, c, "a") for c in "abc"} | {(2, "y", "y")}
    assert {tuple(r) for r in order.strong_components(rel).collect()} == want
    monkeypatch.setattr(order, "_largest_before", lambda *_: 1 / 0)
    assert order.strong_components(rel.where("graph = 1")).count() == 50
