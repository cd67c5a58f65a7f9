"""Quality classifier: a conditional random field over the lines of a text.

Every line has measures of its own and of the lines before and after it. A linear-chain CRF labels lines good or bad;
its marginals, weighted by the length of the lines, average to the share of good text, which a two-parameter logistic
maps to the score.

It is fitted on at most SAMPLE labelled texts of each label (the documented bound), none over LONGEST characters, chosen
by a hash of the id among rows whose crc32(doc_id as text) mod 5 is not 0; a line has the label of its text. Every text
is scored whole.

Defined cases: null or empty texts count as one empty line and get a score like any other; with nothing to learn from,
or one label only, every score is 0.5; ids are compared as values, of an id with several labels the larger is taken, and of one
with several texts the first in order; a null
id is not held out and not learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import crf

SAMPLE = 500
LONGEST = 200_000
ROUNDS = 300
CUTOFF = 0.3

_KINDS = {
    "upper": C.byte_set((65, 90)),
    "digit": C.byte_set((48, 57)),
    "symbol": C.byte_set((35, 38), (42, 42), (60, 60), (62, 62)),
    "pipe": C.byte_set((124, 124)),
    "mark": C.byte_set((33, 34), (39, 41), (43, 47), (58, 59), (61, 61), (63, 64), (91, 96), (123, 123), (125, 126)),
    "space": C.SPACES,
}
_KIND_OF = np.full(256, len(_KINDS), np.int64)
for _k, _set in enumerate(_KINDS.values()):
    _KIND_OF[_set] = _k
_KIND_OF[194:224] = 7  # lead bytes of accented letters: most capitals among them can't be told apart cheaply
N_KINDS = 8
_NL = C.byte_set((10, 10))


def _doc_of(cut: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(cut) - 1), np.diff(cut))


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of every line, its weight, and for each text its range of lines; every text has a line at least."""
    data, off = C.buffers(texts)
    n = len(off) - 1
    breaks = np.flatnonzero(_NL[data]) + 1
    starts = np.sort(np.concatenate([off[:-1], breaks]))  # a text's own start, then one after each line feed
    # a line feed that ends one text has its break at the start of the next one; it belongs to the first
    ends_in = np.searchsorted(off, breaks - 1, side="right") - 1
    per_text = np.bincount(ends_in, minlength=n) + 1
    cut = np.concatenate([[0], np.cumsum(per_text)])
    line_end = np.append(starts[1:], len(data))
    m = len(starts)
    kinds = np.zeros((m, N_KINDS))
    for lo in range(0, len(data), 1 << 20):
        hi = min(lo + (1 << 20), len(data))
        at = np.searchsorted(starts, np.array([lo, hi]), side="right") - 1
        base, top = int(at[0]), int(at[1]) + 1
        line = np.repeat(np.arange(base, top), np.diff(np.clip(np.append(starts[base:top], line_end[top - 1]), lo, hi)))
        kinds[base:top] += np.bincount((line - base) * N_KINDS + _KIND_OF[data[lo:hi]], minlength=(top - base) * N_KINDS).reshape(-1, N_KINDS)
    h, at, wcut = C.word_hashes(texts)
    line_of = np.searchsorted(starts, at, side="right") - 1 if len(at) else np.zeros(0, np.int64)
    words = np.bincount(line_of, minlength=m).astype(float)
    doc = _doc_of(wcut)
    again, heard = np.zeros(m), np.zeros(m)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(line_of[1:], weights=same, minlength=m)
    if len(h) > 3:
        four = C.mix(h[:-3] + h[1:-2] * C._STEP[1] + h[2:-1] * C._STEP[2] + h[3:] * C._STEP[3] + doc[:-3].astype(np.uint64) * C._GOLD)
        _, first = np.unique(four, return_index=True)
        seen = np.ones(len(four))
        seen[first] = 0
        seen[doc[3:] != doc[:-3]] = 0
        heard = np.bincount(line_of[3:], weights=seen, minlength=m)
    size = np.maximum(kinds.sum(1) - kinds[:, 5], 1)
    per_word = np.maximum(words, 1)
    own = np.column_stack([
        kinds[:, 0] / size, kinds[:, 1] / size, np.minimum(kinds[:, 2] / per_word, 4), np.minimum(kinds[:, 3] / per_word, 2), np.minimum(kinds[:, 4] / per_word, 3),
        again / per_word, heard / per_word, np.minimum(size / per_word, 40) / 10, np.log1p(words) / 5, words < 3, kinds[:, 2] > 0.3 * words, kinds[:, 3] > 0.3 * words,
    ])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[cut[:-1]] = 0
    after[cut[1:] - 1] = 0
    return np.column_stack([own, before, after, np.ones(m)]), size, cut


def fit(texts: list[str], labels: list[int]) -> dict | None:
    if len(set(labels)) < 2:
        return None
    x, size, cut = line_features(pa.array(texts))
    y = np.array(labels)[_doc_of(cut)]
    mean, dev = x.mean(0), x.std(0)
    mean[-1], dev[-1] = 0, 1
    dev[dev < 1e-6] = 1
    z = (x - mean) / dev
    # lines weigh the same within a text and texts the same among each other would need weights in the chain; the
    # emission gradient is weighted by text, the chain part is not
    per = 1 / np.diff(cut)[_doc_of(cut)]
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = crf.observed_pairs(y, cut)
    gw, gt = np.full(len(w), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(ROUNDS):
        p, pairs = crf.expected(z @ w, cut, trans)
        g = z.T @ ((y - p) * per) - 1e-2 * w
        t = (seen - pairs) / max(1.0, seen.sum()) * len(texts) * 0.1 - 0.5 * trans
        gw, gt = gw + g * g, gt + t * t
        w, trans = w + 0.3 * g / np.sqrt(gw), trans + 0.05 * t / np.sqrt(gt)
    good = _share(crf.marginals(z @ w, cut, trans), size, cut)
    a, b = _calibrate(_logit(good), np.array(labels))
    return {"w": w, "mean": mean, "dev": dev, "trans": trans, "a": a, "b": b}


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _share(p: np.ndarray, size: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.add.reduceat(p * size, cut[:-1]) / np.add.reduceat(size, cut[:-1])


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope by logistic regression with the labels balanced and a weak pull to 1; shift so that the best cut of x gets the score CUTOFF."""
    order = np.argsort(x, kind="stable")
    bad = np.cumsum(y[order] == 0) / max(1, (y == 0).sum())
    good = np.cumsum(y[order] == 1) / max(1, (y == 1).sum())
    gain = bad - 1.5 * good  # losing a good text is worse
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    k = int(best[len(best) // 2])
    cut = (x[order[k]] + x[order[min(k + 1, len(x) - 1)]]) / 2
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    slope, shift = 1.0, 0.0
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        miss, v = weight * (y - p), weight * p * (1 - p)
        g = np.array([(miss * x).sum() - 0.1 * (slope - 1), miss.sum() - 1e-3 * shift])
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = slope + step[0], shift + step[1]
    slope = float(np.clip(slope, 0.2, 5.0))
    return slope, float(np.log(CUTOFF / (1 - CUTOFF)) - slope * cut)


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for lo, hi in C.row_chunks(b.column(2)):
                texts = b.column(2).slice(lo, hi - lo)
                score = np.full(hi - lo, 0.5)
                if model:
                    x, size, cut = line_features(texts)
                    p = crf.marginals(((x - model["mean"]) / model["dev"]) @ model["w"], cut, model["trans"])
                    score = 1 / (1 + np.exp(-(model["a"] * _logit(_share(p, size, cut)) + model["b"])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= CUTOFF).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int, longest: int, folds: int = 5) -> tuple[list[str], list[int]]:
    """At most so many texts of each label, by a hash of the id, from the folds that are not held out."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    known = known.where(F.crc32(F.col("i").cast("string")) % folds != 0).groupBy("i").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    odds = F.lit(0.0)
    for y, n in counts.items():
        odds = F.when(F.col("y") == y, F.lit(1.3 * most / n)).otherwise(odds)
    drawn = known.withColumn("h", F.pmod(F.xxhash64("i", F.lit(23)), F.lit(1_000_000))).where(F.col("h") < odds * 1_000_000)
    # the order makes the bounded samples the same in every run
    drawn = drawn.orderBy("h", "i").limit(3 * most * len(counts))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= longest))
    rows = texts.join(F.broadcast(drawn), "i").groupBy("i", "y").agg(F.min("t").alias("t")).orderBy("i").limit(3 * most * len(counts)).collect()
    own: dict[int, dict[int, str]] = {}
    for r in sorted(rows, key=lambda r: (r["i"], r["y"], r["t"])):
        kept = own.setdefault(r["y"], {})
        if len(kept) < most:
            kept.setdefault(r["i"], r["t"])
    return [t for y in sorted(own) for t in own[y].values()], [y for y in sorted(own) for _ in own[y]]


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs."""
    spark = docs.sparkSession
    C.batch_rows(spark)
    texts, y = training_sample(docs, labels, label_col, id_col, text_col, SAMPLE, LONGEST, folds)
    sent = spark.sparkContext.broadcast(fit(texts, y))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scorer(sent), "doc_id long, held_out boolean, score double, predicted int")
