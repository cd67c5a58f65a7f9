"""Language-model scores by subword lattice likelihood.

A word's probability is the sum over all its segmentations into pieces of an existing vocabulary, each weighed by the
product of its pieces' probabilities; a forward recursion in log space adds them up. A text's probability is that of its
words and of the end. The vocabulary's own scores are ranks, so they give the pieces Zipf weights; one round of
expectation-maximisation over the training words (forward-backward posteriors times counts) fits these to the corpus.

Words are counted over all texts; each distinct word goes through the lattice once. Words that make up at least one
MOST_COMMON-th of all words are at most MOST_COMMON many, so their scores are broadcast; the other words of each text are
joined by shuffle.

Base score: add-one log10 probabilities of the words and the end.

Defined cases: null and empty texts consist of the end only; null ids are not held out and thus learned from; repeated
rows get equal results; with no training text the pieces keep the vocabulary's weights; empty tables give empty results;
other columns are ignored. Any bytes can be scored, as every byte is a piece.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "piece_bpe_32k.model"
MOST_COMMON = 1_000_000
FOLDS, HELD = 7, 2
#: What the vocabulary's own weights count, in pieces.
PRIOR_PIECES = 1000.0
CHUNK_WORDS = 2_000_000
#: Longer words (bytes) go through the lattice alone, so many places at a time.
LONG = 8192

_INVERSE = C.U64(pow(int(C._GOLD), -1, 1 << 64))
_inverses = np.cumprod(np.full(4096, _INVERSE, C.U64))


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    while len(_inverses) < n:
        _inverses = np.concatenate([_inverses, _inverses * _inverses[-1]])
    return _inverses


def read_pieces(path: str | None) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a leading space for word starts) and log weights from their scores; unusable ones are left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ranks = [], []
    for i in range(model.get_piece_size()):
        if model.is_unknown(i) or model.is_control(i):
            continue
        text, score = model.id_to_piece(i), model.get_score(i)
        if byte := re.fullmatch("<0x([0-9A-F]{2})>", text):
            pieces.append(bytes([int(byte[1], 16)]) + b"\x00byte")
            ranks.append(4.0 * model.get_piece_size())
            continue
        if text == "▁":  # opens words whose first bytes no opening piece has; unusable by its score, so it weighs as a byte
            pieces.append(b" ")
            ranks.append(4.0 * model.get_piece_size())
            continue
        body = text[1:] if text.startswith("▁") else text
        if "▁" in body or score < -1e8:
            continue
        pieces.append((b" " if text.startswith("▁") else b"") + body.encode())
        ranks.append(-score)
    weight = -np.log(np.array(ranks) + 3.0)
    return pieces, weight - np.log(np.exp(weight).sum())


class Lattice:
    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp = logp
        self.size = len(pieces)
        byte_of = {p[0]: i for i, p in enumerate(pieces) if p.endswith(b"\x00byte")}
        self.byte_id = np.array([byte_of[b] for b in range(256)])
        plain = [(i, p) for i, p in enumerate(pieces) if not p.endswith(b"\x00byte")]
        self.space = next(i for i, p in plain if p == b" ")
        self.inner = self._table([(i, p) for i, p in plain if p[:1] != b" "])
        self.first = self._table([(i, p[1:]) for i, p in plain if p[:1] == b" " and len(p) > 1])

    def _table(self, own: list[tuple[int, bytes]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: sorted hashes and piece ids."""
        by: dict[int, list[tuple[int, int]]] = {}
        for i, p in own:
            raw = np.frombuffer(p, np.uint8)
            by.setdefault(len(p), []).append((int((C._BYTE[raw] * C.powers(len(p))[: len(p)]).sum()), i))
        out = {}
        for n, rows in by.items():
            rows.sort()
            out[n] = (np.array([h for h, _ in rows], C.U64), np.array([i for _, i in rows]))
        return out

    @staticmethod
    def _find(table: dict, n: int, h: np.ndarray) -> np.ndarray:
        """Piece ids of the hashes, -1 for none."""
        if n not in table:
            return np.full(len(h), -1)
        keys, ids = table[n]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, ids[at], -1)

    def run(self, raw: np.ndarray, off: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each word raw[off[k]:off[k + 1]]; with counts also the expected piece counts."""
        size = np.diff(off)
        out = np.full(len(size), self.logp[self.space])
        gain = np.zeros(self.size) if counts is not None else None
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        for k in order[size[order] > LONG].tolist():
            out[k] = self._long(raw[off[k] : off[k + 1]], None if counts is None else float(counts[k]), gain)
        order = order[size[order] <= LONG]
        lo = 0
        while lo < len(order):
            hi = lo
            area = 0
            while hi < len(order) and (hi == lo or area + size[order[hi]] <= 200_000):
                area += size[order[hi]]
                hi += 1
                if hi - lo >= 4096:
                    break
            own = order[lo:hi]
            self._group(raw, off[own], size[own], own, out, counts, gain)
            lo = hi
        return out, gain

    def _group(self, raw, start, size, own, out, counts, gain) -> None:
        n, longest = len(own), int(size.max())
        most = min(longest, max([*self.inner, *self.first]))
        grid = np.arange(longest)
        inside = grid < size[:, None]
        b = np.where(inside, raw[np.minimum(start[:, None] + grid, len(raw) - 1)], 0)
        sums = np.zeros((n, longest + 1), C.U64)
        np.cumsum(np.where(inside, C._BYTE[b] * C.powers(longest)[:longest], C.U64(0)), axis=1, out=sums[:, 1:])
        inv = np.concatenate([np.ones(1, C.U64), _inverse_powers(longest)[: longest - 1]])
        none = -np.inf
        step, ids, head, head_ids = [], [], [], []  # by piece length from 1: weights by start; of pieces that open a word
        for k in range(1, most + 1):
            h = (sums[:, k:] - sums[:, :-k]) * inv[: longest - k + 1]
            fits = (grid[: longest - k + 1] + k) <= size[:, None]
            found = np.full(h.shape, -1)
            found[fits] = self._find(self.inner, k, h[fits])
            if k == 1:
                # a byte that is also a piece can be read either way; both add up
                byte = self.byte_id[b]
                both = np.logaddexp(np.where(found >= 0, self.logp[found], none), self.logp[byte])
                step.append(np.where(fits, both, none))
                ids.append(found)
            else:
                step.append(np.where(found >= 0, self.logp[found], none))
                ids.append(found)
            f = np.full(n, -1)
            can = size >= k
            f[can] = self._find(self.first, k, h[can, 0])
            head.append(np.where(f >= 0, self.logp[f], none))
            head_ids.append(f)
        alpha = np.full((n, longest + 1), none)
        alpha[:, 0] = self.logp[self.space]
        for j in range(1, longest + 1):
            ways = [alpha[:, j - k] + step[k - 1][:, j - k] for k in range(1, min(j, most) + 1)]
            if j <= most:
                ways.append(head[j - 1])
            alpha[:, j] = _add(ways)
        total = alpha[np.arange(n), size]
        out[own] = total
        if counts is None:
            return
        beta = np.full((n, longest + 1), none)
        beta[np.arange(n), size] = 0.0
        for j in range(longest - 1, -1, -1):
            ways = [step[k - 1][:, j] + beta[:, j + k] for k in range(1, min(longest - j, most) + 1)]
            beta[:, j] = np.where(j == size, 0.0, _add(ways))
        weight = counts[own]
        with np.errstate(invalid="ignore"):
            gain[self.space] += (np.exp(alpha[:, 0] + beta[:, 0] - total) * weight).sum()
            for k in range(1, most + 1):
                post = np.exp(alpha[:, : longest - k + 1] + step[k - 1] + beta[:, k:] - total[:, None]) * weight[:, None]
                post = np.nan_to_num(post)
                found = ids[k - 1]
                if k == 1:
                    byte = self.byte_id[b]
                    as_byte = np.where(found >= 0, np.exp(self.logp[byte] - step[0]), 1.0)
                    as_byte = np.nan_to_num(np.minimum(as_byte, 1.0))
                    np.add.at(gain, byte[inside], (post * as_byte)[inside])
                    post = post * (1 - as_byte)
                hit = found >= 0
                gain += np.bincount(found[hit], weights=post[hit], minlength=self.size)
                f = head_ids[k - 1]
                hit = f >= 0
                gain += np.bincount(f[hit], weights=(np.exp(head[k - 1] + beta[:, k] - total) * weight)[hit], minlength=self.size)


    def _edges(self, b: np.ndarray, lo: int, hi: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of a long word: for each start in lo .. hi, by piece length, the piece that begins there (-1 for none). Bytes that are
        pieces too have their byte's number in the last array."""
        most = min(len(b), max([*self.inner, *self.first]))
        part = b[lo : min(hi + most, len(b))]
        sums = np.zeros(len(part) + 1, C.U64)
        np.cumsum(C._BYTE[part] * C.powers(len(part))[: len(part)], out=sums[1:])
        inv = np.concatenate([np.ones(1, C.U64), _inverse_powers(len(part))[: len(part) - 1]])
        out = []
        for k in range(1, most + 1):
            n = max(0, min(hi - lo, len(part) - k + 1))
            found = np.full(hi - lo, -1)
            h = (sums[k : k + n] - sums[:n]) * inv[:n]
            found[:n] = self._find(self.inner, k, h)
            out.append(found)
        return out, self.byte_id[part[: hi - lo]]

    def _long(self, b: np.ndarray, weight: float | None, gain: np.ndarray | None) -> float:
        """The same for one word of any length: memory for two numbers a byte, a step for each piece that stands in it."""
        n, logp, space = len(b), self.logp, self.logp[self.space]
        most = min(n, max([*self.inner, *self.first]))
        head = []  # pieces that open the word
        at = C._BYTE[b[:most]] * C.powers(most)[:most]
        for k, h in enumerate(np.cumsum(at, dtype=C.U64), 1):
            if (f := int(self._find(self.first, k, np.array([h]))[0])) >= 0:
                head.append((k, f))
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = space
        ahead: dict[int, list[float]] = {}
        for k, f in head:
            ahead.setdefault(k, []).append(float(logp[f]))
        for lo in range(0, n, LONG):
            hi = min(lo + LONG, n)
            found, byte = self._edges(b, lo, hi)
            steps = self._steps(found, byte)
            for j in range(lo, hi):
                if j:
                    alpha[j] = _add_few(ahead.pop(j))
                for k, _, w in steps[j - lo]:
                    ahead.setdefault(j + k, []).append(alpha[j] + w)
        alpha[n] = total = _add_few(ahead.pop(n))
        if weight is None:
            return total
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0.0
        for hi in range(n, 0, -LONG):
            lo = max(0, hi - LONG)
            found, byte = self._edges(b, lo, hi)
            steps = self._steps(found, byte)
            for j in range(hi - 1, lo - 1, -1):
                beta[j] = _add_few([w + beta[j + k] for k, _, w in steps[j - lo]])
                for k, piece, w in steps[j - lo]:
                    gain[piece] += weight * math.exp(min(0.0, alpha[j] + w + beta[j + k] - total))
        gain[self.space] += weight * math.exp(min(0.0, space + beta[0] - total))
        for k, f in head:
            gain[f] += weight * math.exp(min(0.0, logp[f] + beta[k] - total))
        return total

    def _steps(self, found: list[np.ndarray], byte: np.ndarray) -> list[list[tuple[int, int, float]]]:
        """For each start: (length, piece, weight) of every piece that begins there, the byte itself first."""
        out = [[(1, p, w)] for p, w in zip(byte.tolist(), self.logp[byte].tolist(), strict=True)]
        for k, ids in enumerate(found, 1):
            at = np.flatnonzero(ids >= 0)
            for j, p, w in zip(at.tolist(), ids[at].tolist(), self.logp[ids[at]].tolist(), strict=True):
                out[j].append((k, p, w))
        return out


def _add_few(ways: list[float]) -> float:
    top = max(ways)
    return top + math.log(sum(math.exp(w - top) for w in ways))


def _add(ways: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials."""
    if not ways:
        return np.array(-np.inf)
    x = np.stack(ways)
    top = x.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(0)) + safe


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(start, size)
    return data[at], off


def _word_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """End byte of each word: the next separator or the start of the next text's word; texts are told apart by their starts."""
    sep = np.flatnonzero(C.SPACES[data])
    nxt = np.append(sep, len(data))
    return nxt[np.searchsorted(sep, at)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    words = 0

    def flush() -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        learn = np.concatenate([x[1] for x in held])
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(inv, weights=learn, minlength=len(u)).astype(np.int64)
        n = np.bincount(inv, minlength=len(u)).astype(np.int64)
        base = np.concatenate([[0], np.cumsum([len(x[0]) for x in held])])
        parts = []
        for k, (_, _, data, at, end) in enumerate(held):
            mine = first[(first >= base[k]) & (first < base[k + 1])] - base[k]
            parts.append((np.flatnonzero((first >= base[k]) & (first < base[k + 1])), *_gather(data, at[mine], end[mine] - at[mine])))
        where = np.concatenate([p[0] for p in parts])
        raw = np.concatenate([p[1] for p in parts])
        off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]).astype(np.int32)
        word = pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(C._LOWER[raw].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(u[where].view(np.int64)), word, pa.array(c[where]), pa.array(n[where])], ["wh", "word", "c", "n"])

    for b in batches:
        for lo, hi in C.row_chunks(b.column(1)):
            texts = b.column(1).slice(lo, hi - lo)
            h, at, cut = C.word_hashes(texts)
            if not len(h):
                continue
            data, off = C.buffers(texts)
            doc = np.repeat(np.arange(hi - lo), np.diff(cut))
            end = np.minimum(_word_ends(data, at), off[doc + 1])
            learn = b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(float)[doc]
            held.append((h, learn, data, at, end))
            words += len(h)
            if words >= CHUNK_WORDS:
                yield flush()
                held, words = [], 0
    if held:
        yield flush()


def _words(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    return C.buffers(b.column(b.schema.get_field_index(name)))


def _expect(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*read_pieces(path))
        total = np.zeros(lattice.size)
        for b in batches:
            raw, off = _words(b, "word")
            total += lattice.run(raw, off, b.column(1).to_numpy().astype(float))[1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "e"])

    return run


def _score_words(path: str | None, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(read_pieces(path)[0], weights.value)
        for b in batches:
            raw, off = _words(b, "word")
            p = lattice.run(raw, off)[0] / np.log(10)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(p)], ["wh", "c", "n", "lp"])  # as selected below: wh, word, c, n

    return run


def _score_texts(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, lp = common.value
        for b in batches:
            for lo, hi in C.row_chunks(b.column(2)):
                h, _, cut = C.word_hashes(b.column(2).slice(lo, hi - lo))
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                doc = np.repeat(np.arange(hi - lo), np.diff(cut))
                sums = [np.bincount(doc, weights=np.where(hit, v[at], 0.0) if len(keys) else np.zeros(len(h)), minlength=hi - lo) for v in (c[0], c[1], lp)]
                rest = h[~hit].view(np.int64)
                off = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(cut)), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(off), pa.array(rest))],
                    ["doc_id", "held_out", "n_words", "base", "known", "lp", "rest"],
                )

    return run


def lattice_scores(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs."""
    spark = docs.sparkSession
    C.batch_rows(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.select((~F.col("held_out")).alias("learn"), "text").mapInArrow(_count_words, "wh long, word binary, c long, n long")
    words = C.materialize(counted.groupBy("wh").agg(F.first("word").alias("word"), F.sum("c").alias("c"), F.sum("n").alias("n")))
    ends = rows.where("not held_out").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    n_train, v = sums["c"] + ends, sums["v"] + (ends > 0)

    # probabilities of the pieces; the vocabulary bounds what is collected
    _, prior = read_pieces(path)
    got = words.where("c > 0").select("word", "c").mapInArrow(_expect(path), "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()
    e = np.zeros(len(prior))
    e[got["piece"].to_numpy()] = got["e"].to_numpy()
    weights = np.log(e + PRIOR_PIECES * np.exp(prior)) - np.log(e.sum() + PRIOR_PIECES)
    sent = spark.sparkContext.broadcast(weights)
    scored = words.select("wh", "word", "c", "n").mapInArrow(_score_words(path, sent), "wh long, c long, n long, lp double")
    scored = C.materialize(scored)

    # common words by broadcast, of which there can be MOST_COMMON at most
    least = max(1, -(-sums["n"] // MOST_COMMON))
    space = float(n_train + v + 1)
    table = scored.where(F.col("n") >= least).select("wh", "c", "lp").limit(MOST_COMMON).toArrow()
    keys = table["wh"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    c = table["c"].to_numpy()[order]
    common = spark.sparkContext.broadcast((keys[order], (np.log10((c + 1) / space), (c > 0).astype(float)), table["lp"].to_numpy()[order]))
    hot = rows.mapInArrow(_score_texts(common), "doc_id long, held_out boolean, n_words long, base double, known long, lp double, rest array<long>")
    hot = C.materialize(hot.withColumn("row", F.monotonically_increasing_id()))
    rare = hot.select("row", F.explode("rest").alias("wh")).join(scored.where(F.col("n") < least).select("wh", "c", F.col("lp").alias("w_lp")), "wh")
    rare = rare.groupBy("row").agg(F.sum(F.log10((F.col("c") + 1) / space)).alias("r_base"), F.sum((F.col("c") > 0).cast("long")).alias("r_known"), F.sum("w_lp").alias("r_lp"))
    out = hot.drop("rest").join(rare, "row", "left")
    end_base = float(np.log10((ends + 1) / space))
    stop = (ends + 1) / (n_train + 2)
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("r_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", zero) + end_base).alias("base_score"),
        (F.col("lp") + F.coalesce("r_lp", zero) + F.col("n_words") * float(np.log10(1 - stop)) + float(np.log10(stop))).alias("score"),
    )
