"""Operators over the roles of a corpus, and the rest of the inventory's analysis."""

import pytest

from lautwerk import inventory as I
from lautwerk.operators import analysis, roles
from lautwerk.sources import corpus


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    c = corpus.create(spark, f"{tmp_path_factory.mktemp('c')}/c")
    c.add(spark.createDataFrame([(k, "{}") for k in "abcd"], "entry_id string, meta string"))
    c.put_forms("cited", spark.createDataFrame([("a", "rad"), ("b", "rat"), ("c", "mag")], "entry_id string, form string"), "hand", "1")
    c.put_forms("said", spark.createDataFrame([("a", "rat"), ("b", "rat"), ("c", "mab")], "entry_id string, form string"), "ear", "1")
    return c


RULES = "[obstruent +voiced] ~> [-voiced] / _ #"


def test_query_and_experiment(made):
    assert {(r["entry_id"], r["unit"]) for r in roles.query(made, "[obstruent] / _ #", "cited").collect()} == {("a", "d"), ("b", "t")}
    report = roles.run_experiment(made, "cited", "said", RULES)
    assert {r["class"]: r["n"] for r in roles.counts(report).collect()} == {"unchanged": 1, "derived": 1, "refused": 1, "budget": 0}
    assert roles.coverage(report) == pytest.approx(2 / 3)
    assert {r["verdict"] for r in roles.query_derivations(made, "cited", "said", RULES).collect()} == {"witness", "refused"}
    assert roles.rule_set_identity(RULES) != roles.rule_set_identity(RULES.replace("~>", "->"))


def test_spread(made):
    got = {(r["entry_id"], r["source"], r["kind"], r["left"], r["right"]) for r in roles.spread(made, "cited", "said").collect()}
    assert ("a", "said", "FEATURE", "d", "t") in got and not any(g[0] == "b" for g in got)


def test_remove_and_assets(spark, made):
    corpus.put_assets(made, spark.createDataFrame([("a", "wav", "a.wav")], "entry_id string, kind string, path string"))
    assert corpus.asset_kinds(made).first()["n"] == 1
    with pytest.raises(corpus.CorpusError):
        corpus.put_assets(made, spark.createDataFrame([("zz", "wav", "a.wav")], "entry_id string, kind string, path string"))
    made.put_split("train", spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ordinal long, entry_id string"))
    assert {(r["entry_id"], r["code"]) for r in made.validate().where("code <> 'unknown_symbol'").collect()} == {(k, "missing_asset") for k in "bcd"}
    fresh = corpus.remove(made, spark.createDataFrame([("a",)], "entry_id string"))
    assert [r[0] for r in fresh.ids().collect()] == ["b", "c", "d"] and fresh.forms().count() == 4
    assert [tuple(r) for r in fresh.split("train").collect()] == [(1, "b"), (2, "c")]
    assert corpus.assets(fresh).count() == 0 and corpus.manifest(fresh) == corpus.manifest(made)


def test_forms_are_put_one_by_one(spark, tmp_path):
    c = corpus.create(spark, f"{tmp_path}/c", "mine")
    c.add(spark.createDataFrame([("a", "{}", "ana"), ("b", "{}", None)], "entry_id string, meta string, form string"), {"cited": "form"}, "hand", "1")
    put = lambda *rows: c.put_forms("cited", spark.createDataFrame(rows, "entry_id string, form string"), "ear", "2")
    put(("b", "bab"))
    put(("a", "ama"))
    assert {(r["entry_id"], r["form"], r["version"]) for r in c.forms("cited").collect()} == {("a", "ama", "2"), ("b", "bab", "2")}
    assert [r["role"] for r in c.roles_of("b").collect()] == ["cited"] and c.read_all(spark.createDataFrame([("a",)], "entry_id string")).count() == 1
    for bad in ((("z", "a"),), (("a", "a"), ("a", "b"))):
        with pytest.raises(corpus.CorpusError):
            put(*bad)
    with pytest.raises(corpus.CorpusError):
        c.add(spark.createDataFrame([("no id", "{}")], "entry_id string, meta string"))


def test_ingest(spark, tmp_path):
    (tmp_path / "d.dict").write_text(";;; head\nHELLO HH AH0 L OW1\nHELLO(2) HH EH0 L OW1\nBAD ZZZ\n")
    c = corpus.create(spark, f"{tmp_path}/c")
    refused = corpus.ingest_cmudict(c, f"{tmp_path}/d.dict").collect()
    assert [tuple(r) for r in refused] == [(4, "BAD", "unknown: ZZZ")]
    assert {(r["entry_id"], r["form"]) for r in c.forms("cited").collect()} == {("hello.1.2", "həlˈo͜ʊ"), ("hello.2.3", "hɛlˈo͜ʊ")}


def test_costs():
    assert roles.costs_from_rules("t -> ∅ / _ #\n∅ -> e / # _ s") == ({"t": 0.25}, {"e": 0.25})


def test_inventory():
    assert len(I.phones()) == 139
    assert not [p for p in analysis.integrity() if not p[1].startswith("same")]
    with pytest.raises(ValueError):
        analysis.supplemented({"p": {}})
    assert "ʭ" in analysis.supplemented({"ʭ": {"manner": "fricative", "place": "dental", "voiced": "-"}})
    codes = analysis.features_to_shorts(I.full()["p"])
    assert analysis.shorts_to_features(codes) == I.full()["p"]
    assert analysis.hierarchy_text(["p", "b"]).startswith("voiced=+") and "->" in analysis.hierarchy_dot(["p", "b"])
    assert (analysis.glottal_aperture(I.full()["ʔ"]), analysis.velic_aperture(I.full()["m"])) == (0.0, 1.0)
    assert [c[0] for c in analysis.constrictions(I.full()["w"])] == ["bilabial", "velar"]
