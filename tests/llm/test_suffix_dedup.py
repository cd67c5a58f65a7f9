"""Removal of repeated passages against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lautwerk.llm import suffix_dedup as sd

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(rows):
    """rows: (id, text) in order of the table."""
    seen, out = set(), Counter()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - sd.SPAN + 1):
            w = raw[p : p + sd.SPAN]
            if w in seen:
                gone[p : p + sd.SPAN] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(raw)]).sum())
        out[i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def result(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def texts(seed=1, n=120):
    draw = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "ü", "中文", "x", "", "\n", "one two three", "the end of the line"]
    prose = lambda k: " ".join(draw.choice(words) + str(draw.randrange(50)) for _ in range(k))
    passage, line = prose(40), prose(12)
    out = [None, "", "short", "a" * 99, "a" * 100, "a" * 5000, "a" * 101, "ab" * 300, "ab" * 60, passage, passage, passage + passage, "y" + passage[:-3] + "z"]
    for _ in range(n):
        base = prose(draw.randrange(1, 60))
        kind = draw.randrange(6)
        if kind == 0:
            base += passage[draw.randrange(30) : draw.randrange(100, 300)] + prose(9)
        elif kind == 1:
            old = draw.choice(out) or ""
            at = draw.randrange(len(old) + 1)
            base = old[:at] + "*" + old[at:]
        elif kind == 2:
            base = base + line + prose(20) + line + prose(3)
        elif kind == 3:
            base = draw.choice(out)
        out.append(base)
    return out


@pytest.mark.parametrize("least_heavy", [sd.LEAST_HEAVY, 2])
def test_repeats_of_odd_texts(spark, least_heavy):
    rows = list(enumerate(texts()))
    random.Random(2).shuffle(rows)
    rows = [(-1, None)] + rows + [(None, rows[0][1]), (10**15, texts()[9])]
    df = spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], "doc_id long, text string, anchor string, row int, id int, spans string").repartition(7)
    assert result(sd.suffix_dedup(df, least_heavy=least_heavy)) == plain(rows)


def test_rows_that_share_ids(spark):
    rows = [(1, "q" * 150), (1, "q" * 150), (None, "q" * 130), (None, "r" * 120), (2, "r" * 140), (2, "r" * 140)]
    got = result(sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    assert got == plain(rows)


def test_blocks_change_nothing(spark, monkeypatch):
    """The same in tiny pieces, folds and blocks (one process: tasks see the changed bounds only through the functions called here)."""
    import pyarrow as pa

    rows = list(enumerate(texts(3, 60)))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t or "" for _, t in rows])], ["id", "row", "text"])
    seen = []
    for piece, held in ((1 << 20, 1 << 21), (150, 40)):
        monkeypatch.setattr(sd, "PIECE", piece)
        monkeypatch.setattr(sd, "HELD", held)
        monkeypatch.setattr(sd, "ROWS", held)
        covered = set()
        for b in sd._folded(np.zeros(0, np.uint64))(iter([batch])):
            for _, segment, shape, i, _, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                covered.update((i, p) for p in range(start, segment if shape < 0 else start + sd.SPAN + (shape & 0xFF)))
        assert covered == {(i, p) for i, t in rows if len((t or "").encode()) >= sd.SPAN for p in range(len(t.encode()))}
        seen.append(covered)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(sd.suffix_dedup(df)) == plain(rows)


def test_equal_windows_have_equal_anchors():
    draw = random.Random(5)
    a = np.array([draw.choice(b"abc") for _ in range(3000)], np.uint8)
    b = np.concatenate([a[500:1800], np.array([draw.choice(b"abc") for _ in range(500)], np.uint8)])
    of = []
    for x in (a, b):
        anchor, _, first, last, at, _ = sd.segments(x, np.array([0, len(x)]))
        of.append({int(p): (int(h), int(j - p)) for h, lo, hi, j in zip(anchor, first, last, at, strict=True) for p in range(lo, hi + 1)})
        assert len(of[-1]) == len(x) - sd.SPAN + 1
    for p in range(1800 - 500 - sd.SPAN + 1):
        assert of[0][500 + p] == of[1][p]


def test_interleave_is_the_order_of_suffixes():
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 6, 400))
    right = rng.integers(0, 2, (400, 12)).astype(np.uint8)
    at, common = sd.interleave(group, right)
    keys = [(int(group[k]), right[k].tobytes()) for k in at]
    assert keys == sorted(keys)
    for k in range(400):
        if k == 0 or keys[k][0] != keys[k - 1][0]:
            assert common[k] == -1
        else:
            x, y = keys[k - 1][1], keys[k][1]
            assert common[k] == next((i for i in range(12) if x[i] != y[i]), 12)


def test_repeats_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(sd.suffix_dedup(df)) == plain([(r["doc_id"], r["text"]) for r in df.collect()])


def test_no_documents(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
