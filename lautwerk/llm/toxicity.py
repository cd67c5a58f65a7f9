"""Toxicity: a conditional random field that tags toxic spans.

Words carry a bias, two hashes of their own, their first four, five and six bytes, as hashed features. Only texts are labelled, so the words of toxic training texts that share a feature found far more often in toxic than in other texts
are taken as toxic. A linear-chain CRF is fitted to these tags; forward-backward marginals of a text give its offending
words (marginal of at least CUTOFF) and, as their maximum, its score.

It is fitted on at most SAMPLE labelled texts of each label (the documented bound), none over LONGEST characters, chosen
by a hash of the id among rows whose crc32(doc_id as text) mod 5 is not 0. Every text is scored whole.

Defined cases: null or empty texts, and every text when there is nothing to learn from, have score 0 and no offsets; a
null id is not held out and not learned from; of an id with several labels the larger is taken, and of one with several
texts the first in order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import crf
from .quality_crf import training_sample

SAMPLE = 700
LONGEST = 60_000
BUCKETS = 1 << 20
ROUNDS = 25
CUTOFF = 0.5
#: A feature marks toxic words when it is so many times likelier in toxic training texts, and the likelihood ratio against
#: chance (G squared) is so large that none of some hundred thousand features should reach it by accident.
LEAST_RATIO = 12.0
LEAST_EVIDENCE = 28.0

_PARTS = (4, 5, 6)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of every word (a row each), the words' start bytes, and for each text its range of words."""
    data, off = C.buffers(texts)
    h, at, cut = C.word_hashes(texts, C.NOT_ALNUM)
    rows = [h, C.mix(h ^ C._GOLD)]  # two of the word itself, so that one of a byte or two isn't taken for a collision
    if len(h):
        end = np.append(at[1:], len(data))
        fold = C._LOWER
        part, length = np.zeros(len(h), np.uint64), 0
        for k in range(max(_PARTS)):
            inside = at + k < end
            byte = fold[data[np.minimum(at + k, len(data) - 1)]]
            inside &= ~C.NOT_ALNUM[byte]
            if k:
                inside &= alive
            alive = inside
            part = np.where(alive, part + C._BYTE[byte] * C.powers(16)[k], part)
            if k + 1 in _PARTS:
                # a word shorter than the part has no such feature
                rows.append(np.where(alive, C.mix(part + C.U64(k + 101)), C.U64(0)))
    else:
        rows += [h] * len(_PARTS)
    ids = np.stack([(r ^ C.U64(97 * i)) % C.U64(BUCKETS) for i, r in enumerate(rows)], 1).astype(np.int64)
    for i in range(1, len(rows)):
        ids[rows[i] == 0, i] = BUCKETS
    return ids, at, cut


def fit(texts: list[str], labels: list[int]) -> dict | None:
    if len(set(labels)) < 2:
        return None
    ids, _, cut = features(pa.array(texts))
    doc = np.repeat(np.arange(len(texts)), np.diff(cut))
    y_doc = np.array(labels)
    # a feature is counted once for each pair of words that it stands between, so that copies of a text count once
    h = ids[:, 0].astype(np.uint64)
    around = np.zeros(len(h), np.uint64)
    around[1:] += h[:-1] * C._STEP[1]
    around[:-1] += h[1:] * C._STEP[2]
    df = np.zeros((2, BUCKETS + 1))
    for y in (0, 1):
        mine = y_doc[doc] == y
        for col in range(ids.shape[1]):
            own = ids[mine, col]
            _, first = np.unique(C.mix(around[mine] + own.astype(np.uint64) * C._STEP[3]), return_index=True)
            df[y] += np.bincount(own[first], minlength=BUCKETS + 1)
    df[:, BUCKETS] = 0
    n = np.maximum(df.sum(1), 1.0)
    ratio = (df[1] + 0.1) / n[1] / ((df[0] + 0.5) / n[0])
    seen = df.sum(0)
    chance = seen * n[1] / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * (np.where(df[1] > 0, df[1] * np.log(df[1] / chance), 0) + np.where(df[0] > 0, df[0] * np.log(df[0] / (seen - chance)), 0))
    marked = (ratio >= LEAST_RATIO) & (evidence >= LEAST_EVIDENCE)
    marked[BUCKETS] = False
    y = ((marked[ids].sum(1) > 1) & (y_doc[doc] == 1)).astype(int)  # one mark alone may be a collision
    w = np.where(marked, 1.5, np.where(df.sum(0) > 0, -0.5, 0.0))
    w[BUCKETS] = 0
    bias, trans = -2.0, np.zeros((2, 2))
    pairs_seen = crf.observed_pairs(y, cut)
    gw, gb, gt = np.full(BUCKETS + 1, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(ROUNDS):
        p, pairs = crf.expected(w[ids].sum(1) + bias, cut, trans)
        miss = y - p
        g = sum(np.bincount(ids[:, c], weights=miss, minlength=BUCKETS + 1) for c in range(ids.shape[1])) - 1e-3 * w
        g[BUCKETS] = 0
        t = pairs_seen - pairs - 0.1 * trans
        gw, gb, gt = gw + g * g, gb + miss.sum() ** 2, gt + t * t
        w, bias, trans = w + 0.5 * g / np.sqrt(gw), bias + 0.2 * miss.sum() / np.sqrt(gb), trans + 0.1 * t / np.sqrt(gt)
    return {"w": w.astype(np.float32), "bias": float(bias), "trans": trans}


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for lo, hi in C.row_chunks(b.column(2)):
                n = hi - lo
                score, places = np.zeros(n), [[] for _ in range(n)]
                if model:
                    ids, _, cut = features(b.column(2).slice(lo, n))
                    if len(ids):
                        p = crf.marginals(model["w"][ids].sum(1).astype(float) + model["bias"], cut, model["trans"])
                        full = np.diff(cut) > 0
                        score[full] = np.maximum.reduceat(p, cut[:-1][full])
                        for at in np.flatnonzero(p >= CUTOFF).tolist():
                            d = int(np.searchsorted(cut, at, side="right")) - 1
                            places[d].append(at - int(cut[d]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(score), pa.array((score >= CUTOFF).astype(np.int32)), pa.array(places, pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "toxic_words"]
                )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted, toxic_words), a row for each row of docs; toxic_words: places from 0."""
    spark = docs.sparkSession
    C.batch_rows(spark)
    texts, y = training_sample(docs, labels, label_col, id_col, text_col, SAMPLE, LONGEST, folds)
    sent = spark.sparkContext.broadcast(fit(texts, y))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scorer(sent), "doc_id long, held_out boolean, score double, predicted int, toxic_words array<long>")
