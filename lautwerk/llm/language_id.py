"""Language identification with string kernels.

A text is the set of its byte n-grams for n = 1, 2, 3 (A-Z lowered); the blended-spectrum presence kernel of two texts is
the number of n-grams they share, over the geometric mean of their numbers. Landmark texts give a Nyström map, and kernel
ridge regression fits one output for each language against the rest. As all of it is linear in the presence vector up to
its norm, a batch of texts is scored by two matrix products. The vector has a place for every n-gram of a landmark, as others
share nothing with one; the norm counts all n-grams of the text.

The model is fitted on at most SAMPLE texts of each language (the documented bound), taken by a hash of the id among the
rows whose crc32(doc_id as text) mod 5 is not 0 and that have a language; every text is scored whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything when there is nothing to
learn from; a null id is not held out and not learned from; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 240
LANDMARKS = 48
RIDGE = 0.02
SHARPNESS = 6.0
UNKNOWN = "und"

_FOLD = C._LOWER
_LETTER = C.byte_set((65, 90), (97, 122))


def _codes(raw: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams of a text, told apart by n."""
    a = _FOLD[raw].astype(np.int32)
    out = [a]
    if len(a) > 1:
        two = (a[:-1] << 8) | a[1:]
        out.append(two)
        if len(a) > 2:
            out.append((two[:-1] << 8) | a[2:])
    return out


class Presence:
    """Presence vectors over a vocabulary of n-grams, given as (n - 1) << 24 | code."""

    def __init__(self, grams: np.ndarray):
        self.size = len(grams)
        self.tables = []
        for n in range(3):
            own = np.flatnonzero(grams >> 24 == n)
            table = np.full(1 << 8 * (n + 1), self.size, np.int32)  # the last column is for what isn't in the vocabulary
            table[grams[own] & 0xFFFFFF] = own
            self.tables.append(table)

    def matrix(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Presence vectors, and the root of the number of all n-grams that each text has."""
        out, others = np.zeros((len(texts), self.size + 1), np.float32), np.zeros(len(texts))
        for k, raw in enumerate(texts):
            row, strange = out[k], [np.zeros(0, np.int32)]
            for at in range(0, len(raw), 1 << 20):  # long texts in pieces that overlap by two bytes
                for n, (table, codes) in enumerate(zip(self.tables, _codes(raw[at : at + (1 << 20) + 2]))):
                    found = table[codes]
                    row[found] = 1
                    if (left := codes[found == self.size]).size:
                        strange.append(np.unique(left) | (n << 24))
            others[k] = len(np.unique(np.concatenate(strange)))
        return out[:, : self.size], np.sqrt(np.maximum(out[:, : self.size].sum(1) + others, 1)).astype(np.float32)


def fit(texts: list[str], langs: list[str]) -> dict | None:
    """Vocabulary, landmarks and coefficients; None without texts."""
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    names = sorted(set(langs))
    if not names:
        return None
    own = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    marks = [i for n in names for i in own[n][:LANDMARKS]]
    grams = np.unique(np.concatenate([c | (n << 24) for i in marks for n, c in enumerate(_codes(raws[i]))]))
    p, norm = Presence(grams).matrix(raws)
    land = p[marks] / norm[marks, None]
    k = (p / norm[:, None]) @ land.T
    value, vector = np.linalg.eigh(k[marks].astype(np.float64))
    keep = value > 1e-6 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])
    phi = np.c_[k @ white, np.ones(len(k))]
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1 / np.array([len(own[x]) for x in langs])  # each language weighs the same
    a = (phi * weight[:, None]).T @ phi + RIDGE / len(names) * np.eye(phi.shape[1]) / 10
    coef = np.linalg.solve(a, (phi * weight[:, None]).T @ y)
    return {"grams": grams, "land": land.astype(np.float32), "coef": (white @ coef[:-1]).astype(np.float32), "bias": coef[-1].astype(np.float32), "names": names}


def score(model: dict, presence: Presence, raws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its share among the outputs."""
    p, norm = presence.matrix(raws)
    out = (p @ model["land"].T / norm[:, None]) @ model["coef"] + model["bias"]
    e = np.exp(SHARPNESS * (out - out.max(1, keepdims=True)))
    return out.argmax(1), e.max(1) / e.sum(1)


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        presence = Presence(model["grams"]) if model else None
        for b in batches:
            for lo, hi in C.row_chunks(b.column(2), rows=256):
                texts = b.column(2).slice(lo, hi - lo)
                data, off = C.buffers(texts)
                raws = [data[off[i] : off[i + 1]] for i in range(hi - lo)]
                has = [bool(_LETTER[r].any()) or any(c.isalpha() for c in r.tobytes().decode()) for r in raws]
                lang, share = [UNKNOWN] * len(raws), np.zeros(len(raws))
                if model:
                    best, value = score(model, presence, raws)
                    lang = [model["names"][k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
                    share = np.where(has, value, 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(share.astype(float))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs."""
    spark = docs.sparkSession
    C.batch_rows(spark)
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    learn = docs.where((fold != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in learn.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    model = None
    if counts:
        # the hash thins each language to about its share of the sample; what comes above the bound is cut
        most = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * SAMPLE / n))))
        drawn = learn.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1_000_000)) < F.try_element_at(most, F.col(lang_col)) * 1_000_000)
        # the order makes the bounded sample the same in every run
        chosen = drawn.select(F.xxhash64(F.col(id_col), F.lit(11)).alias("h"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
        rows = chosen.orderBy("h", "i", F.xxhash64("t"), "l").limit(2 * SAMPLE * len(counts)).collect()
        kept: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["l"], r["i"], r["t"])):
            if len(own := kept.setdefault(r["l"], [])) < SAMPLE:
                own.append(r["t"])
        model = fit([t for own in kept.values() for t in own], [k for k, own in kept.items() for _ in own])
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scorer(sent), "doc_id long, held_out boolean, lang_pred string, score double")
