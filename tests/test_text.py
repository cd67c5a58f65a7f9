"""Reading transcriptions."""

import pytest
from pyspark.sql import functions as F

from lautwerk.functions import notation as N
from lautwerk.functions import text as X


def one(spark, column, form):
    return spark.createDataFrame([(form,)], "form string").select(column(F.col("form")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "form, units",
    [("t͡ʃe͜ɪnd͡ʒ", ["t͡ʃ", "e͜ɪ", "n", "d͡ʒ"]), ("pʰˈɪn", ["pʰ", "ˈɪ", "n"]), ("a.ba#", ["a", "b", "a"]), ("", []), ("k͡xaː", ["k͡x", "aː"]), ("a\u0303", ["a\u0303"])],
)
def test_units(spark, form, units):
    assert one(spark, X.units, form) == units


def test_tokens_keep_boundaries(spark):
    assert one(spark, X.tokens, "a.b|c") == ["a", ".", "b", "|", "c"]
    assert [tuple(r) for r in one(spark, X.boundaries, "ab.c#")] == [(2, "."), (3, "#")]


def test_null_and_lost(spark):
    assert one(spark, X.units, None) is None
    assert one(spark, X.lost, "aX1b") == ["X", "1"]


def test_wild_import(spark):
    assert one(spark, X.from_wild, "ga:ʧ ä é") == "ɡaːt͡ʃ ä e\u0301"


@pytest.mark.parametrize(
    "form, codes",
    [("ab", []), ("", ["no_segments"]), (None, ["no_segments"]), ("aX", ["unknown_symbol"]), ("ʰa", ["orphan_diacritic"]), ("aʰʰ", ["duplicate_diacritic"]), ("a͡", ["malformed_tie"])],
)
def test_findings(spark, form, codes):
    assert one(spark, X.findings, form) == codes
    assert one(spark, X.is_valid, form) == (not codes)


def test_stress_moves(spark):
    assert one(spark, X.stress_to_nucleus, "əˈtak") == "ə.tˈak"
    assert one(spark, X.stress_to_syllable, "ə.tˈak") == "əˈtak"


def test_small_functions(spark):
    assert one(spark, X.bare, "ˈaː") == "a"
    assert one(spark, X.add_ties, "ts") == "t͡s" and one(spark, X.add_ties, "aɪ") == "a͜ɪ"
    assert one(spark, X.strip_syllable_breaks, "a.b") == "ab"
    assert one(spark, X.segmented, "t͡sa") == "t͡s a" and one(spark, X.normalize, "t͡s a") == "t͡sa"
    assert [tuple(r) for r in one(spark, X.prosody, "ˈaːb")] == [(0, "ˈ"), (0, "ː")]


def test_cmu(spark):
    assert one(spark, N.to_cmu, "həlˈo͜ʊ") == ["HH", "AH0", "L", "OW1"]
    back = spark.createDataFrame([(["HH", "AH0", "L", "OW1"],)], "s array<string>").select(N.from_cmu(F.col("s"))).first()[0]
    assert back == "həlˈo͜ʊ"


def test_other_notations(spark):
    assert one(spark, N.to_xsampa, "ʃˈiː") == 'S"i:'
    assert one(spark, N.from_xsampa, 'S"i:') == "ʃˈiː"
    assert one(spark, N.to_kirshenbaum, "t͡ʃɪn") == "tSIn" and one(spark, N.from_kirshenbaum, "tSIn") == "t͡ʃɪn"
    assert one(spark, N.to_timit, "t͡ʃɪn") == ["ch", "ih", "n"]
    assert one(spark, lambda c: N.unconvertible(c, N.table("timit")), "tøn") == ["ø"]


def test_marks_go_there_and_back(spark):
    rows = [("n̥", "n_0"), ("t̪", "t_d"), ("a̯", "a_^"), ("k͡p", "k_p"), ("a͜ɪ", "a_I"), ("ˈt͡ʃiːˌã", '"t_Si:%a~'), ("ä̃", 'a_"~'), ("u᷈", "u_L_H_L"), ("a↗b‖", "a<R>b||"), ("œ͜y", "9_y")]
    for ipa, ascii_ in rows:
        assert one(spark, N.to_xsampa, ipa) == ascii_ and one(spark, N.from_xsampa, ascii_) == ipa
        assert one(spark, lambda c: N.losses_to(c, "xsampa"), ipa) == []
    assert len(N.XSAMPA.split()) == 2 * 178 and len(N.table("xsampa")) == 178
    for ipa, ascii_ in [("pʰat", "p[h]at"), ("n̩", "n="), ("ɹ̩ã", "r=a~"), ("ˈt͡ʃiː", "'tSi:"), ("tʰts", "t[h]ts")]:
        assert one(spark, N.to_kirshenbaum, ipa) == ascii_
    assert one(spark, N.from_kirshenbaum, "p[h]at'n=tS") == "pʰatˈn̩t͡ʃ"
    assert one(spark, N.to_kirshenbaum, "n̥ä") == "n" and one(spark, lambda c: N.losses_to(c, "kirshenbaum"), "n̥ä") == ["̥", "ä"]
    assert one(spark, N.to_xsampa, "ʧ") == "t_S" and one(spark, N.to_kirshenbaum, "ʧtʃ") == "tStS"
    assert one(spark, lambda c: F.array_join(N.to_timit(c), " "), "hɛloʊ") == "hh eh l ow"
    assert one(spark, N.to_xsampa, None) is None and one(spark, N.to_xsampa, "") == ""
    for strict in (N.to_xsampa, N.to_kirshenbaum):
        with pytest.raises(Exception, match="can't carry 1 9"):
            one(spark, lambda c, f=strict: f(c, strict=True), "a919")
    with pytest.raises(Exception, match="can't carry"):
        one(spark, lambda c: N.from_kirshenbaum(c, strict=True), "a[x]")
