"""Features of units, kinds, wire format, comparison and the command line."""

import pytest
from pyspark.sql import functions as F

from lautwerk import cli
from lautwerk.functions import segments as S
from lautwerk.operators import compare
from lautwerk.sources import alignment


def test_describe():
    assert S.describe("p") == "voiceless bilabial plosive" and S.describe("z") == "voiced alveolar sibilant fricative" and S.describe("7") == ""


def test_with_features(spark):
    df = spark.createDataFrame([("tʰ",), ("b̥",), ("ˈãː",), ("7",), (None,)], "u string")
    got = [r["features"] for r in S.with_features(df, "u").collect()]
    by = {r["u"]: r["features"] for r in S.with_features(df, "u").collect()}
    assert len(got) == 5 and by["7"] is None and by[None] is None
    assert by["tʰ"]["release"] == "aspirated" and by["b̥"]["voiced"] == "-"
    assert (by["ˈãː"]["nasalized"], by["ˈãː"]["length"], by["ˈãː"]["stress"]) == ("+", "long", "primary")


@pytest.mark.parametrize("unit, kind", [("t", "atomic"), ("t͡s", "affricate"), ("a͜ɪ", "diphthong"), ("k͡p", "double-articulation"), ("n͡d", "prenasalized"), ("d͡n", "pre-stopped"), ("t͡l", "lateral-release"), ("k͡ǃ", "click-accompaniment"), ("s͡w", "overlay"), ("a͜ɪ͜ə", "diphthong"), ("t͡s͜a", "chain")])
def test_kind(spark, unit, kind):
    assert spark.createDataFrame([(unit,)], "u string").select(S.kind(F.col("u"))).first()[0] == kind


def test_wire(spark):
    df = spark.createDataFrame([("t͡sa",), (None,), ("",)], "f string").select("f", S.form_to_json(F.col("f")).alias("j"))
    rows = df.select("f", "j", S.form_from_json(F.col("j")).alias("x")).collect()
    assert rows[0]["x"]["units"] == ["t͡s", "a"] and rows[1]["j"] is None and rows[2]["x"]["units"] == []
    other = spark.createDataFrame([('{"type":"form","v":1}',), ("nonsense",)], "j string").select(S.form_from_json(F.col("j"))).collect()
    assert [r[0] for r in other] == [None, None]
    assert S.canonical_json({"b": 1, "a": "ɡ"}) == '{"a":"ɡ","b":1}' and len(S.identity_fingerprint([])) == 64


def test_spellings(spark):
    df = spark.createDataFrame([("hao", 3), ("gou", 3), ("liu", 2), ("ma", 5), ("lv", 4)], "s string, t int")
    assert [r[0] for r in df.select(S.pinyin(F.col("s"), F.col("t"))).collect()] == ["hǎo", "gǒu", "liú", "ma", "lǜ"]
    df = spark.createDataFrame([("ka",), ("pi",), ("n",), ("su",), ("xx",)], "m string")
    assert [r[0] for r in df.select(S.katakana(F.col("m"))).collect()] == ["カ", "ピ", "ン", "ス", None]


def test_comparison(spark):
    df = spark.createDataFrame([(1, "tan", "dans"), (2, None, "a"), (3, "a", "a")], "k int, a string, b string")
    got = {(r["k"], r["kind"], r["left"], r["right"]) for r in compare.disagreements(df, ["k"], "a", "b").collect()}
    assert got == {(1, "FEATURE", "t", "d"), (1, "STRUCTURE", None, "s")}
    cost = df.select(compare.directional_distance(F.col("a"), F.col("b"), insert={"s": 0.25})).collect()
    assert cost[0][0] == pytest.approx(0.35) and cost[1][0] is None
    assert [r[0] for r in df.select(compare.is_similar(F.col("a"), F.col("b"), 0.8)).collect()] == [True, None, True]
    assert not df.select(compare.is_similar(F.col("a"), F.lit("aaaaaaaaa"), 0.8)).first()[0]


def test_tree_and_dot(spark):
    df = spark.createDataFrame([(1, "pa.ta#ka")], "k int, f string")
    rel = compare.tree(df, "k", "f")
    assert {(r["src"], r["tgt"]) for r in rel.where("src = 'form' or src = 'w0'").collect()} == {("form", "w0"), ("form", "w1"), ("w0", "w0.s0"), ("w0", "w0.s1")}
    assert compare.to_dot(rel).first()["dot"].startswith('digraph {\n"form" -> "w0"')


def test_trajectory(spark):
    rows = compare.trajectory(spark.createDataFrame([("pa",), ("",)], "f string"), "f", 2).orderBy("frame").collect()
    assert [(r["frame"], round(r["offset"], 2)) for r in rows] == [(0, 1.0), (1, 0.5), (2, 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"frame_rate": 100, "words": [{"word": "hi", "start": 0, "duration": 30, "phones": [{"phone": "HH", "start": 0, "duration": 10}, {"phone": "SIL", "start": 10, "duration": 5}]}]}')
    assert [(r["phone"], r["duration"]) for r in alignment.read_alignment(spark, f"{tmp_path}/a.json").collect()] == [("HH", 0.1)]
    (tmp_path / "m.tsv").write_text("\tp\tb\np\t0\t0.2\nb\t0.4\t0\n")
    assert {(r["a"], r["b"], round(r["d"], 3)) for r in alignment.load_matrix_tsv(spark, f"{tmp_path}/m.tsv").collect()} >= {("p", "b", 0.3), ("b", "p", 0.3)}
    (tmp_path / "m.json").write_text('{"phones": ["p", "b", "t"], "upper": [0.1, 0.2, 0.3]}')
    assert {(r["a"], r["b"]): r["d"] for r in alignment.load_matrix_json(spark, f"{tmp_path}/m.json").collect()}["t", "b"] == 0.3
    alignment.save_matrix(spark, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").count() == 139 * 138 // 2


def test_command_line(spark, capsys):
    assert cli.main(["phones", "plosive velar"]) == 0 and capsys.readouterr().out == "k ɡ ɠ\n"
    assert cli.main(["distance", "p", "b"]) == 0 and float(capsys.readouterr().out) == pytest.approx(0.05)
    assert cli.main(["phones", "nonsense"]) == 2
    assert cli.main(["find", "t / _ #", "tat"]) == 0 and capsys.readouterr().out == "2:t\n"
    assert cli.main(["rewrite", "d -> t / _ #", "dad"]) == 0 and capsys.readouterr().out == "dat\n"
    assert cli.main(["tokenize", "aX"]) == 3
