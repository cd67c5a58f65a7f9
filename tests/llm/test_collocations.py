"""Collocations against a plain count of all n-grams."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lautwerk.llm import collocations as col

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(texts, top=col.TOP):
    f, totals = defaultdict(Counter), Counter()
    for text, lang in texts:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= 30 and len(p) > 1}
        around = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if 100 * around[p] >= 80 * a and around[p]:
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def odd_texts():
    draw = random.Random(4)
    names = ["new", "York", "city", "of", "the", "a", "a\x01", "ü", "state", "b", "x" * 100, "…", "中文", "don't", "a\x00b"]
    weights = [8, 8, 4, 12, 14, 6, 3, 4, 4, 3, 3, 2, 2, 2, 2]
    out = [(None, "en"), ("", None), (" \t\n. ", "en"), ("the the the the the. " * 50, "de"), ("one two three four five " * 40, None), ("one two three four five, " * 40, "und"), ("word " * 40_000, "en")]
    for _ in range(600):
        words = draw.choices(names, weights, k=draw.randrange(1, 60)) + (["rare%d" % draw.randrange(400)] if draw.random() < 0.5 else [])
        text = "".join(w + draw.choice([" "] * 20 + ["  ", "\t", ". ", ",", "\n", "!?", " ; "]) for w in words)
        out.append((text, draw.choice(["en", "en", "de", None, "fr"])))
    return out


@pytest.mark.parametrize("most_common", [col.MOST_COMMON, 6])
def test_collocations_of_odd_texts(spark, most_common):
    texts = odd_texts()
    df = spark.createDataFrame([(*t, "clash", "clash", 1, 2) for t in texts], "text string, lang string, key string, phrase string, n long, id int").repartition(5)
    want = plain(texts)
    assert len(want) > 100
    assert rows(col.collocations(df, most_common=most_common)) == want


def test_collocations_keep_the_first(spark):
    texts = odd_texts()
    df = spark.createDataFrame(texts, "text string, lang string")
    assert rows(col.collocations(df, top=7)) == plain(texts, 7)


def test_collocations_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows(col.collocations(df)) == plain([(r["text"], r["lang"]) for r in df.collect()])


def test_collocations_of_nothing(spark):
    for texts in ([], [(None, None)], [("rare words only", "en")]):
        assert col.collocations(spark.createDataFrame(texts, "text string, lang string")).count() == 0


def test_blocks_and_ranges_change_nothing(spark, monkeypatch):
    texts = odd_texts()
    df = spark.createDataFrame(texts, "text string, lang string")
    texts_df = df.selectExpr("coalesce(text, '') AS text", "coalesce(lang, 'und') AS lang")
    encoded = col.encode(texts_df, col.dictionary(texts_df))
    want = {(bytes(r["key"]), r["a"]) for r in col.frequent_ngrams(encoded).collect()}
    raw = [pa.RecordBatch.from_arrays([pa.array([bytes(r["ids"]) for r in encoded.collect()], pa.binary())], ["ids"])]

    class Held:
        value = [(5 << 32 | 3, 0), (9 << 32, 0)]

    whole = Counter()
    for block in (1 << 22, 100):
        monkeypatch.setattr(col, "BLOCK", block)
        counts, seen = Counter(), {}
        for b in col._keys(Held, None)(iter(raw)):
            for part, key, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts[key] += n
                assert seen.setdefault(key, part) == part == sum(h.to_bytes(8, "big") + x.to_bytes(8, "big") <= key for h, x in Held.value)
        assert not whole or counts == whole
        whole = counts
    assert {k for k, n in whole.items() if n >= 30} == {k for k, _ in want if k[8:] == bytes(8)}


def test_radix_order():
    rng = np.random.default_rng(3)
    for _ in range(5):
        hi, lo = rng.integers(0, 1 << 40, 1000, np.uint64) >> np.uint64(rng.integers(0, 39)), rng.integers(0, 1 << 63, 1000, np.uint64)
        order = col.radix_order([hi, lo])
        assert order.tolist() == np.lexsort([lo, hi]).tolist()
