"""Corpora, dictionaries, intervals, graphs and streams."""

import pytest
from pyspark.sql import functions as F

from lautwerk.operators import graph, intervals
from lautwerk.sources import corpus
from lautwerk.streaming import ingest


def test_corpus(spark, tmp_path):
    c = corpus.create(spark, f"{tmp_path}/c", "v1")
    assert c.forms().count() == 0 and c.validate().count() == 0
    with pytest.raises(corpus.CorpusError):
        corpus.create(spark, f"{tmp_path}/c")
    c.add(spark.createDataFrame([("a", "{}"), ("b", None), ("x", "{oops")], "entry_id string, meta string"))
    for bad in ([("a", "{}")], [("d", "{}"), ("d", "{}")], [(None, "{}")]):
        with pytest.raises(corpus.CorpusError):
            c.add(spark.createDataFrame(bad, "entry_id string, meta string"))
    c.put_forms("cited", spark.createDataFrame([("a", "ana"), ("b", "ʰa")], "entry_id string, form string"), "hand", "1")
    with pytest.raises(corpus.CorpusError):
        c.put_forms("cited", spark.createDataFrame([("zz", "ana")], "entry_id string, form string"), "hand", "1")
    again = corpus.open_corpus(spark, f"{tmp_path}/c")
    assert [r[0] for r in again.ids().collect()] == ["a", "b", "x"]
    assert [(r["entry_id"], r["form"]) for r in again.read("a").collect()] == [("a", "ana")]
    assert {(r["entry_id"], r["code"]) for r in again.validate().collect()} == {("b", "orphan_diacritic"), ("x", "bad_meta")}
    before = again.fingerprint()
    again.put_forms("cited", spark.createDataFrame([("b", "ʰa"), ("a", "ana")], "entry_id string, form string"), "hand", "1")
    assert again.fingerprint() == before
    again.put_split("train", spark.createDataFrame([(1, "b"), (0, "a")], "ordinal long, entry_id string"))
    assert [r["entry_id"] for r in again.split("train").collect()] == ["a", "b"]
    again.put_split("old", spark.createDataFrame([(0, "gone")], "ordinal long, entry_id string"))
    with pytest.raises(corpus.CorpusError):
        again.split("old")
    with pytest.raises(corpus.CorpusError):
        corpus.open_corpus(spark, f"{tmp_path}/none")


def test_dictionaries(spark, tmp_path):
    (tmp_path / "d.dict").write_text(";;; head\nHELLO HH AH0 L OW1\nHELLO(2) HH EH0 L OW1\nBAD ZZZ\n# note\n")
    r = corpus.read_cmudict(spark, f"{tmp_path}/d.dict").orderBy("line").collect()
    assert [(x["word"], x["phones"][-1], x["reason"]) for x in r] == [("HELLO", "OW1", None), ("HELLO", "OW1", None), ("BAD", "ZZZ", "unknown: ZZZ")]
    (tmp_path / "i.txt").write_text("word\t/wɜd/, /wɝd/\nodd\t/w1d/\n")
    r = corpus.read_ipa_dict(spark, f"{tmp_path}/i.txt")
    rows = r.orderBy("line").collect()
    assert rows[0]["variants"] == ["wɜd", "wɝd"] and rows[0]["reason"] is None and rows[1]["reason"] is not None
    assert corpus.emit_ipa_dict(r.orderBy("line")).first()[0] == "word\t/wɜd/, /wɝd/"
    (tmp_path / "m.dict").write_text("hi\th aj\n")
    assert corpus.read_mfa_dict(spark, f"{tmp_path}/m.dict").first()["phones"] == ["h", "aj"]
    (tmp_path / "p.csv").write_text("InventoryID,Glottocode,ISO6393,LanguageName,Phoneme,Allophones,Marginal\n1,x,eng,English,p,p pʰ,FALSE\n2,y,deu,German,b,b,TRUE\n")
    p = corpus.read_phoible(spark, f"{tmp_path}/p.csv", "eng").collect()
    assert [(x["phoneme"], x["allophones"], x["marginal"]) for x in p] == [("p", ["p", "pʰ"], False)]


@pytest.mark.parametrize("form, syllables", [("kasa", ["ka", "sa"]), ("patɾon", ["pa", "tɾon"]), ("kanta", ["kan", "ta"]), ("a", ["a"]), ("sol", ["sol"]), ("maestɾo", ["ma", "es", "tɾo"]), ("", [])])
def test_syllables(spark, form, syllables):
    df = spark.createDataFrame([(form,)], "form string")
    assert df.select(intervals.syllabify(F.col("form"))).first()[0] == syllables


def test_intervals(spark):
    df = spark.createDataFrame([("patɾon",)], "form string")
    got = df.select(intervals.as_intervals(intervals.syllabify(F.col("form")), "syllable")).first()[0]
    assert [(x["start"], x["end"]) for x in got] == [(0, 2), (2, 6)]
    assert df.select(intervals.mora_count(F.col("form"))).first()[0] == 3
    a = spark.createDataFrame([(1, "syllable", 0, 2), (1, "syllable", 2, 4)], "f int, tier string, start int, end int")
    b = spark.createDataFrame([(1, "syllable", 0, 2), (1, "word", 0, 4)], "f int, tier string, start int, end int")
    assert {(r["tier"], r["start"], r["side"]) for r in intervals.interval_differences(a, b, ["f"]).collect()} == {("syllable", 2, "left"), ("word", 0, "right")}


def test_rebase(spark):
    edits = "array(struct(2 as at, 1 as removed, 3 as added))"
    df = spark.createDataFrame([(0, 5), (0, 2), (3, 4)], "s int, e int").withColumn("x", F.expr(edits))
    got = [r[0] for r in df.select(intervals.rebase(F.col("s"), F.col("e"), F.col("x"))).collect()]
    assert [tuple(g) for g in got] == [(0, 7), (0, 2), (5, 6)]
    inside = spark.createDataFrame([(0, 3)], "s int, e int").withColumn("x", F.expr("array(struct(2 as at, 2 as removed, 0 as added))"))
    assert inside.select(intervals.rebase(F.col("s"), F.col("e"), F.col("x"))).first()[0] is None


def test_graph(spark):
    rel = spark.createDataFrame(
        [(1, "contains", "r", 0, "a"), (1, "contains", "r", 1, "b"), (1, "contains", "a", 0, "c"), (2, "contains", "x", 0, "y"), (2, "contains", "y", 0, "x"), (1, "alternatives", "s", 0, "a"), (1, "selects", "s", 0, "b"), (1, "selects", "t", 0, "a"), (1, "selects", "t", 0, "b")],
        "graph int, name string, src string, ordinal int, tgt string",
    )
    roots = spark.createDataFrame([(1, "r")], "graph int, root string")
    assert {(r["node"], r["depth"]) for r in graph.descendants(rel, roots).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    assert {r["node"] for r in graph.leaves(rel, roots).collect()} == {"b", "c"}
    assert {r["parent"] for r in graph.parents(rel).where("node = 'c'").collect()} == {"a"}
    assert {(r["graph"], r["node"]) for r in graph.cycles(rel).collect()} == {(2, "x"), (2, "y")}
    bad = {(r["src"], r["reason"]) for r in graph.choice_violations(rel).collect()}
    assert ("s", "not an alternative") in bad and ("t", "several selections") in bad


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("gato\nX1\n")
    s = ingest.accepted_and_refused(ingest.read_lines(spark, f"{tmp_path}/in"))
    ingest.write_forms(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    (tmp_path / "in" / "b.txt").write_text("ana\n")
    s = ingest.accepted_and_refused(ingest.read_lines(spark, f"{tmp_path}/in"))
    ingest.write_forms(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    got = {(r["form"], str(r["accepted"]).lower() == "true") for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("ɡato", True), ("X1", False), ("ana", True)}


def test_deep_graphs_and_long_cycles(spark):
    chain = [(1, "contains", f"n{k}", 0, f"n{k + 1}") for k in range(20)]
    ring = [(2, "contains", f"r{k}", 0, f"r{(k + 1) % 20}") for k in range(20)]
    rel = spark.createDataFrame(chain + ring, "graph long, name string, src string, ordinal int, tgt string")
    found = graph.leaves(rel, spark.createDataFrame([(1, "n0")], "graph long, root string")).collect()
    assert [(r["node"], r["depth"]) for r in found] == [("n20", 20)]
    assert {(r["graph"], r["node"]) for r in graph.cycles(rel).collect()} == {(2, f"r{k}") for k in range(20)}
