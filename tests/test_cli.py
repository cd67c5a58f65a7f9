"""Commands on strings, files and columns."""

import json

import pytest

from lautwerk import cli


def out(capsys, *argv):
    status = cli.main(list(argv))
    return status, capsys.readouterr().out.splitlines()


@pytest.mark.parametrize(
    "argv, status, lines",
    [
        (("convert", "tokenize", "t͡ʃan"), 0, ["t͡ʃ a n"]),
        (("convert", "tokenize", "ta7"), 3, ["t a"]),
        (("convert", "to-ipa", "HH AH0 L OW1"), 0, ["həlˈo͜ʊ"]),
        (("convert", "to-katakana", "sa ku ra"), 0, ["サクラ"]),
        (("query", "find", "t / _ #", "tat"), 0, ["2:t"]),
        (("query", "find", "t", "tat", "ana", "--filter"), 0, ["tat"]),
        (("query", "find", "[nonsense]", "tat"), 2, []),
        (("query", "list", "plosive", "velar"), 0, ["k ɡ ɠ"]),
        (("rules", "apply", "german-final-devoicing", "rad"), 0, ["rat"]),
        (("rules", "derives", "t ~> s / _ i", "titi>siti"), 0, ["witness"]),
        (("rules", "morae", "nihon"), 0, ["ni ho n"]),
        (("distance", "pair", "p", "b"), 0, ["0.05"]),
        (("distance", "word", "tan", "tan"), 0, ["0.0"]),
        (("distance", "pair", "p"), 2, []),
        (("analysis", "natural-class", "t", "7"), 2, []),
        (("hierarchy", "text", "p", "b"), 0, ["voiced=+: b", "voiced=-: p"]),
    ],
)
def test_commands(spark, capsys, argv, status, lines):
    assert out(capsys, *argv) == (status, lines)


def test_reads_run(spark, capsys):
    for group, commands in cli.READS.items():
        for name in commands:
            if group not in ("phoible", "distance", "rules"):
                assert out(capsys, group, name, *(["t"] if group in ("analysis", "features") else []))[0] == 0
    assert all(json.loads(x) for x in out(capsys, "analyze", "summary", "--format", "json")[1])


def test_files(spark, capsys, tmp_path):
    (tmp_path / "f.txt").write_text("tat\nana\n")
    assert out(capsys, "query", "find", "[nasal]", "--file", f"{tmp_path}/f.txt") == (0, ["", "1:n"])
    (tmp_path / "f.csv").write_text("id,form\n1,tat\n2,ana\n")
    status, lines = out(capsys, "convert", "to-xsampa", "--file", f"{tmp_path}/f.csv", "--column", "form", "--format", "json")
    assert status == 0 and [json.loads(x)["result"] for x in lines] == ["tat", "ana"]
