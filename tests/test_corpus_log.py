"""Changes of a corpus are there as a whole or not at all."""

import pytest

from lautwerk.sources import corpus as C


def made(spark, path, n=4):
    c = C.create(spark, str(path))
    c.add(spark.createDataFrame([(f"e{k}", "{}", f"ta{k}", "x") for k in range(n)], "entry_id string, meta string, a string, b string"), {"one": "a", "two": "b"}, "p", "1")
    return c


def content(c):
    return sorted((r["entry_id"], r["role"], r["form"]) for r in c.forms().collect())


def test_later_rows_count(spark, tmp_path):
    c = made(spark, tmp_path / "c")
    first = c.last_entry()
    put = lambda rows, v: c.put_forms("one", spark.createDataFrame(rows, "entry_id string, form string"), "p", v)
    put([("e1", "new"), ("e2", "new")], "2")
    put([("e1", "newer")], "3")
    assert content(c) == [("e0", "one", "ta0"), ("e0", "two", "x"), ("e1", "one", "newer"), ("e1", "two", "x"), ("e2", "one", "new"), ("e2", "two", "x"), ("e3", "one", "ta3"), ("e3", "two", "x")]
    assert {r["form"] for r in c.as_of(first).forms("one").collect()} == {"ta0", "ta1", "ta2", "ta3"}
    C.remove(c, spark.createDataFrame([("e1",), ("e0",)], "entry_id string"))
    assert {r["entry_id"] for r in c.forms().collect()} == {"e2", "e3"} and c.count() == 2
    c.add(spark.createDataFrame([("e1", "{}", "back")], "entry_id string, meta string, a string"), {"one": "a"}, "p", "4")
    put([("e3", "last")], "5")
    assert {(r["entry_id"], r["form"]) for r in c.forms("one").collect()} == {("e1", "back"), ("e2", "new"), ("e3", "last")}
    before = content(c)
    c.compact()
    assert content(c) == before and c.count() == 3
    c.vacuum()
    assert content(c) == before
    with pytest.raises(C.CorpusError):
        c.as_of(first).put_split("s", spark.createDataFrame([(1, "e2")], "ordinal long, entry_id string"))


@pytest.mark.parametrize("change", ["add", "put", "remove", "compact"])
def test_a_writer_that_stops_leaves_the_old_state(spark, tmp_path, monkeypatch, change):
    c = made(spark, tmp_path / "c")
    c.put_forms("one", spark.createDataFrame([("e1", "old")], "entry_id string, form string"), "p", "2")
    before = content(c)
    monkeypatch.setattr(C.Corpus, "_enter", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    run = {
        "add": lambda: c.add(spark.createDataFrame([("e9", "{}", "z")], "entry_id string, meta string, a string"), {"one": "a"}),
        "put": lambda: c.put_forms("one", spark.createDataFrame([("e1", "new")], "entry_id string, form string"), "p", "3"),
        "remove": lambda: C.remove(c, spark.createDataFrame([("e1",)], "entry_id string")),
        "compact": c.compact,
    }[change]
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.undo()
    assert content(c) == before and c.count() == 4
    run()
    assert (content(c) == before) == (change == "compact")


def test_an_entry_that_was_cut_short_is_passed_over(spark, tmp_path):
    c = made(spark, tmp_path / "c")
    before = content(c)
    (tmp_path / "c" / "log" / f"{c.last_entry() + 1:012d}").write_text('{"forms/one": [["data/x"')
    assert content(c) == before
    c.put_forms("one", spark.createDataFrame([("e1", "new")], "entry_id string, form string"), "p", "3")
    assert ("e1", "one", "new") in content(c)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    c = made(spark, tmp_path / "c")
    seen = c._state()[0]
    rows = spark.createDataFrame([("e1", "wav", "p")], C.ASSETS)
    c._change([("assets", rows, "new")], seen)
    with pytest.raises(C.CorpusError, match="meanwhile"):
        c._change([("assets", rows, "new")], seen)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 7)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {k}{' pad' * (k % 9)}\n" for k in range(1, n + 1)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "100b")
        rows = C.numbered(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 5007 and all(int(r["value"].split()[1]) == r["line"] for r in rows)
