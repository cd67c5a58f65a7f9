"""Structures of units, and the rest of the reads and edits of forms, notations, rules and graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lautwerk.functions import algebra as A
from lautwerk.functions import notation as N
from lautwerk.functions import segments as S
from lautwerk.functions import text as X
from lautwerk.operators import analysis, distance, find, graph, rewrite, roles


def value(spark, column, **named):
    return spark.createDataFrame([tuple(named.values())], ", ".join(f"{k} string" for k in named)).select(column).first()[0]


@pytest.fixture(scope="module")
def flat(spark):
    """Reads of a unit, by unit."""
    units = ["t", "t̪͡s", "k͡p", "p͡k", "ɡ͡b̥", "b̥͡ɡ", "t͡s͜a", "a͜ɪ̃", "u͡i", "i͡u", "kʷ͡p", "ŋ͡m͡ɡ͡b", "ˈaː", "7", None]
    df = spark.createDataFrame([(u,) for u in units], "u string").withColumn("s", A.structure(F.col("u"))).withColumn("b", A.bundles(F.col("s"), False))
    j = F.col("s.junctures")
    read = df.select(
        "u", A.scalar(F.col("s"), False).alias("flat"), A.disagreements(F.col("b")).alias("dis"), A.children(F.col("b"), j).alias("kids"), A.classify(F.col("b"), j).alias("kind"), A.phased(F.col("b"), j).alias("phased"),
        A.edge_features(F.col("s"), False, False).alias("first"), A.edge_features(F.col("s"), True, False).alias("last"), A.to_ipa(F.col("s")).alias("ipa"), A.spelling(A.unmarked(F.col("s"))).alias("bare"),
        (A.segment_from_json(A.segment_to_json(F.col("s"))) == F.col("s")).alias("round"), A.is_nucleus(F.col("s")).alias("nucleus"), A.raised_prominence(F.col("s")).alias("raised"), A.prosody_of(F.col("s")).alias("prosody"),
    )
    return {r["u"]: r for r in read.collect()}


def test_projection(flat):
    assert flat["t̪͡s"]["flat"]["place"] == "alveolar" and flat["t̪͡s"]["flat"]["manner"] == "affricate"
    assert flat["k͡p"]["flat"] == flat["p͡k"]["flat"] and flat["k͡p"]["flat"]["place"] == "bilabial^velar"
    assert flat["ɡ͡b̥"]["flat"] == flat["b̥͡ɡ"]["flat"] and flat["ɡ͡b̥"]["flat"]["voiced"] == "-"
    assert flat["u͡i"]["flat"] == flat["i͡u"]["flat"] and flat["u͡i"]["flat"]["backness"] == "front^back"
    assert flat["kʷ͡p"]["flat"]["labialized"] == "+" and "nasalized" not in flat["a͜ɪ̃"]["flat"]
    assert flat["t͡s͜a"]["flat"]["manner"] == "affricate" and flat["t͡s͜a"]["last"]["manner"] == "vowel" and flat["t͡s͜a"]["first"]["manner"] == "affricate"


def test_structure(flat):
    assert [tuple(c) for c in flat["ŋ͡m͡ɡ͡b"]["kids"]] == [(0, 2), (2, 4)] and [tuple(c) for c in flat["t͡s͜a"]["kids"]] == [(0, 2), (2, 3)]
    assert flat["t"]["kids"] == [] and flat["k͡p"]["dis"] == {"place": ["velar", "bilabial"]} and flat["t"]["dis"] == {}
    assert flat["k͡p"]["phased"] is False and flat["t̪͡s"]["phased"] is True
    assert all(r["ipa"] == u and r["round"] for u, r in flat.items() if u not in ("7", None))
    assert flat["t̪͡s"]["bare"] == "t͡s" and flat["ˈaː"]["prosody"] == {"stress": "primary", "length": "long"}
    assert flat["ˈaː"]["nucleus"] and flat["ˈaː"]["raised"] and not flat["t"]["nucleus"]
    for u in ("7", None):
        assert flat[u]["flat"] is None and flat[u]["kind"] is None and flat[u]["kids"] is None


def test_values(spark):
    assert value(spark, A.expand(F.col("v")), v="bilabial^velar") == ["bilabial", "velar"] and value(spark, A.steps(F.col("v")), v="mid>high") == ["mid", "high"]
    assert value(spark, A.move("height", F.col("v"), 1), v="mid") == "close-mid" and value(spark, A.move("height", F.col("v"), -1), v="open") is None
    assert value(spark, A.with_prosody(F.col("v"), F.array(F.lit("ː"))), v="ˈa") == "ˈaː"
    built = A.build_segment(F.array(F.lit("t"), F.lit("s")), F.array(F.lit("fuse")), F.array().cast("array<string>"))
    assert value(spark, A.to_ipa(built), v="") == "t͡s" and value(spark, A.segment_from_json(F.col("v")), v='{"type":"other","v":3}') is None


def test_text(spark):
    assert [tuple(x) for x in value(spark, X.parse(F.col("f")), f="ˈt͡sʰa")] == [("t͡s", ["ˈ", "ʰ"]), ("a", [])]
    assert value(spark, X.rebuild(X.units(F.col("f")), X.boundaries(F.col("f"))), f="ˈta.na#ba‖") == "ˈta.na#ba‖"
    assert value(spark, X.is_structural(F.col("f")), f=".#") and not value(spark, X.is_structural(F.col("f")), f="a.")
    assert value(spark, X.carries_no_segment(F.col("f")), f="ˈ.") and X.import_phoneset(["g", "ʧ", "\u00e9"]) == ["ɡ", "t͡ʃ", "e\u0301"]
    with pytest.raises(Exception, match="can't read 7"):
        value(spark, X.read_strict(F.col("f")), f="a7")
    assert value(spark, X.findings(F.col("f")), f="a" + "".join(["\u0303", "\u0330", "\u0324", "\u0325", "\u0308", "\u031a", "\u033d"])) == []


def test_notation(spark):
    v = value(spark, N.vocabulary_map(F.col("f"), {"t͡ʃ": "tS", "t": "t", "a": "a"}, ("ˈ",)), f="ˈt͡ʃa t7")
    assert (v["symbols"], v["refused"]) == (["tS", "a", "t"], ["7"])
    back = value(spark, N.vocabulary_read(F.split("f", " "), {"t͡ʃ": "tS", "a": "a"}), f="tS a ?")
    assert (back["form"], back["refused"]) == ("t͡ʃa", ["?"])
    assert value(spark, N.losses(F.col("f"), "cmu"), f="taqa") == ["a", "q"] and N.features_from("AA1", "cmu")["backness"] == "back" and N.features_from("?!", "xsampa") is None
    p = value(spark, S.pinyin_input(F.col("f")), f="lu:4")
    assert (p["syllable"], p["tone"]) == ("lü", 4) and value(spark, S.tone_index(F.col("f")), f="guo") == 2 and value(spark, S.tone_index(F.col("f")), f="xiao") == 2
    k = value(spark, S.katakana_word(F.split("f", " ")), f="sa ku ra q")
    assert (k["text"], k["refused"]) == ("サクラ", ["q"])


def test_find_and_rules(spark):
    assert value(spark, find.offsets(F.col("f"), "t / _ #"), f="tat#t͡sat") == [2, 8]
    e = value(spark, rewrite.edits(F.col("f"), "[obstruent +voiced] -> [-voiced] / _ #"), f="d͡ʒad#ab")
    assert [tuple(x) for x in e] == [(2, "d", "t"), (4, "b", "p")] and value(spark, rewrite.recognize(F.col("f"), "t -> t / a _"), f="tat") in ([2], [])
    assert value(spark, find.sites(F.col("f"), "t / s ([vowel])* _"), f="s" + "a" * 40 + "t")[0]["pos"] == 41
    assert value(spark, find.sites(F.col("f"), "t / _ ([vowel]){9,} s"), f="t" + "a" * 90 + "s")[0]["pos"] == 0 and value(spark, find.sites(F.col("f"), "t / _ ([vowel]){9,} s"), f="taas") == []
    for name in rewrite.available():
        assert rewrite.shipped(name)
    assert value(spark, rewrite.rewrite(F.col("f"), rewrite.shipped("spanish-accented-english")), f="stɹɪŋ") == "estɾin"
    assert value(spark, rewrite.rewrite(F.col("f"), rewrite.shipped("german-final-devoicing")), f="ɡʁab.ɡʁab") == "ɡʁap.ɡʁap"
    for form, want in (("kæt", "katːo"), ("stɹit", "sutoɾiːto"), ("bʊk", "bukːu"), ("mæt͡ʃ", "mat͡ɕːi"), ("tim", "tiːmu"), ("sɔŋ", "soːŋɡu")):
        assert value(spark, rewrite.rewrite(F.col("f"), rewrite.shipped("japanese-moraic")), f=form) == want
    assert rewrite.regime("t -> ∅") == "lossy" and rewrite.regime("θ -> s") == "length-preserving"
    df = spark.createDataFrame([("ti" * 9,), ("ti",)], "f string")
    assert [r["f"] for r in rewrite.unexplored(df, "f", "t ~> s / _ i").collect()] == ["ti" * 9]
    a = spark.createDataFrame([(1, "derived")], "k int, class string")
    with pytest.raises(ValueError):
        rewrite.compare_experiments(a, a.withColumn("k", F.lit(2)), "k")


def test_models(spark, tmp_path):
    m = distance.DistanceModel.from_matrix(spark.createDataFrame([("x", "y", 0.2), ("y", "x", 0.4), ("x", "z", 0.9), ("y", "z", 0.5)], "a string, b string, d double"))
    assert m.raw("x", "y") == pytest.approx(0.3) and m.confusability("x", "y") == 1 and m.confusability("x", "z") == pytest.approx(1 / 3) and m.raw("x", "?") == 1
    assert {(r["a"], r["b"]) for r in m.nearest(spark, 1).collect()} == {("x", "y"), ("y", "x"), ("z", "y")}
    own = distance.DistanceModel(["p", "b", "t", "a", "s"])
    df = spark.createDataFrame([("pat", "bas"), ("", "a"), (None, "a")], "a string, b string")
    got = df.select(own.word_distance(F.col("a"), F.col("b")).alias("d"), own.word_similarity(F.col("a"), F.col("b")).alias("s"), own.is_similar(F.col("a"), F.col("b"), 0.5).alias("i"), own.directional_word_distance(F.col("a"), F.col("b"), 0.5, 2.0).alias("x")).collect()
    want = min(own.sub_cost("p", "b"), 2) + min(own.sub_cost("t", "s"), 2)
    assert got[0]["d"] == pytest.approx(want) and got[0]["s"] == pytest.approx(1 - want / 6) and got[1]["d"] == 1 and got[1]["x"] == 2 and got[2]["d"] is None
    ranked = distance.rank_sequences(spark.createDataFrame([(["t", "a"],)], "u array<string>"), "u", [("da", ["d", "a"]), ("ta", ["t", "a"])], 2).orderBy("rank").collect()
    assert [r["accepted"] for r in ranked] == ["ta", "da"] and distance.shortened() is not None
    assert np.isclose(value(spark, distance.sequence_similarity(F.split("a", ""), F.split("b", "")), a="ta", b="ta"), 1)
    roles.write_report(spark.createDataFrame([("a", "derived")], "entry_id string, class string"), f"{tmp_path}/r")
    assert roles.read_report(spark, f"{tmp_path}/r").first()["class"] == "derived"


def test_analysis(spark):
    assert analysis.declaring_mark("nasalized", "+") == "̃" and analysis.declaring_mark("stress", "primary") == "ˈ" and analysis.declaring_mark("manner", "nasal") is None
    assert [analysis.modifier_mode(m) for m in ("ˈ", "ʰ", "ʷ", "̥", "̃", "͡")] == ["prosodic", "release", "secondary", "overriding", "additive", "structural"]
    assert {r["what"]: r["n"] for r in analysis.summary(spark).collect()}["phones"] == 139 and "vowel" not in analysis.consonant_manners()
    assert analysis.natural_class(["tʲ", "dʲ"])["palatalized"] == "+" and analysis.feature_applies("height", "a") and not analysis.feature_applies("height", "t")
    with pytest.raises(ValueError):
        analysis.natural_class(["t", "7"])
    assert analysis.hierarchy(["t", "a", "d"])[0][1].startswith("manner") and analysis.hierarchy(["t"]) == []


def test_graph_edits(spark):
    rel = spark.createDataFrame([(1, "contains", "r", 0, "b"), (1, "contains", "r", 1, "a"), (1, "contains", "b", 0, "x"), (1, "contains", "a", 0, "x"), (1, "contains", "a", 1, "y")], "graph int, name string, src string, ordinal int, tgt string")
    roots = spark.createDataFrame([(1, "r")], "graph int, root string")
    assert [r["node"] for r in graph.walk(rel, roots).orderBy("place").collect()] == ["b", "x", "a", "y"]
    assert [r["node"] for r in graph.expand_phrase(rel, roots).orderBy("place").collect()] == ["x", "y"]
    x = spark.createDataFrame([(1, "x")], "graph int, node string")
    assert sorted(r["route"] for r in graph.ancestor_routes(rel, x).collect()) == [["a", "r"], ["b", "r"]]
    assert {r["ancestor"]: r["depth"] for r in graph.ancestors(rel, x).collect()} == {"a": 1, "b": 1, "r": 2}
    assert [r["node"] for r in graph.graph_roots(rel).collect()] == ["r"] and graph.references(rel, x).count() == 2
    tiers = spark.createDataFrame([(1, "x", "segment"), (1, "a", "word")], "graph int, node string, tier string")
    assert [r["node"] for r in graph.descendants_on_tier(rel, roots, tiers, "segment").collect()] == ["x"]
    assert [r["tgt"] for r in graph.lexical_projection(rel, tiers, "word").collect()] == ["a"]
    more = graph.contain(rel, spark.createDataFrame([(1, "b", 0, "z"), (1, "y", 0, "w")], "graph int, src string, ordinal int, tgt string"))
    assert {(r["src"], r["ordinal"], r["tgt"]) for r in more.collect()} >= {("b", 1, "z"), ("y", 0, "w")}
    less = graph.remove_nodes(rel, spark.createDataFrame([(1, "b")], "graph int, node string"))
    assert {(r["src"], r["ordinal"], r["tgt"]) for r in less.collect()} == {("r", 0, "a"), ("a", 0, "x"), ("a", 1, "y")}
    assert graph.from_json(graph.to_json(rel)).exceptAll(rel).count() == 0
    declared = spark.createDataFrame([("contains", 1, True, True)], "name string, most int, ordered boolean, acyclic boolean")
    bad = rel.unionAll(spark.createDataFrame([(1, "odd", "r", 0, "x"), (2, "contains", "p", 1, "q"), (2, "contains", "q", 0, "p")], rel.schema))
    got = {(r["graph"], r["src"], r["reason"]) for r in graph.relation_violations(bad, declared).collect()}
    assert got == {(1, "r", "not declared"), (1, "r", "too many targets"), (1, "a", "too many targets"), (2, "p", "ordinals"), (2, "p", "cycle"), (2, "q", "cycle")}
    events = spark.createDataFrame([(1, "x", "segment", 2, 0), (1, "y", "segment", 1, 1), (1, "z", "segment", 1, 0)], "graph int, node string, tier string, tick int, idx int")
    assert [r["node"] for r in graph.events_at(events, "segment", 1).collect()] == ["z", "y"]
    assert {r["node"]: r["place"] for r in graph.positions(events).collect()} == {"z": 0, "y": 1, "x": 2}


def test_syllable_marks(spark):
    from lautwerk.operators import intervals

    assert value(spark, intervals.syllable_marks(F.col("f")), f="patɾon") == [2] and value(spark, intervals.syllabify(F.col("f"), [("fricative", "plosive")]), f="pasta") == ["pa", "sta"]
    got = value(spark, intervals.syllable_conflicts(F.col("f")), f="pat.ɾo.na")
    assert [tuple(x) for x in got] == [(2, "derived"), (3, "written")]


def test_derivations_and_tracks(spark, tmp_path):
    from lautwerk.operators import compare
    from lautwerk.sources import alignment, corpus

    df = spark.createDataFrame([("a", "tad")], "id string, f string")
    rel = rewrite.derivation_graph(df, "id", "f", "t -> s ; one\nd -> t / _ # ; two").collect()
    assert {(r["name"], r["src"], r["tgt"]) for r in rel} == {("one", "0:tad", "1:sad"), ("two", "1:sad", "2:sat")}
    x = compare.unit_extents(df, "f").orderBy("place").collect()
    assert [(r["unit"], r["first"], r["last"]) for r in x] == [("t", 0, 2), ("a", 3, 6), ("d", 7, 8)]
    assert compare.track(df, "id", "f").agg(F.max("seconds")).first()[0] == pytest.approx(0.08) and compare.costs_identity({"t": 1.0}) != compare.costs_identity()
    assert [r["unit"] for r in find.find(df, "f", "d / a _", wild=True).collect()] == ["d"] and find.wild_query("g / [vowel length=long] _ :") == "ɡ / [vowel length=long] _ ː"
    (tmp_path / "p.txt").write_text("SIL\ng\n\nt\n")
    assert [tuple(r) for r in alignment.read_phoneset(spark, f"{tmp_path}/p.txt").orderBy("line").collect()] == [("ɡ", 2), ("t", 4)]
    (tmp_path / "m.tsv").write_text("\tx\ty\nx\t0\t0.2\ny\t0.4\t0\n")
    assert alignment.distance_model(spark, f"{tmp_path}/m.tsv").raw("x", "y") == pytest.approx(0.3)
    seg = spark.createDataFrame([("1", "p"), ("2", "b")], "InventoryID string, phoneme string")
    bib = spark.createDataFrame([("1", "key", "spa")], "InventoryID string, BibtexKey string, Source string")
    assert {(r["InventoryID"], r["bibtex_key"]) for r in corpus.phoible_sources(seg, bib).collect()} == {("1", "key"), ("2", None)}
