"""Token counts without token ids.

A byte-level BPE merges inside pre-tokens only, so a text has as many tokens as its pre-tokens have together.

1. Pre-tokens of all texts are counted; each task adds up its own before the shuffle.
2. Each distinct pre-token is tokenized once, on the cluster; only its number of pieces is kept.
3. The frequencies of each text are joined to these numbers and summed. Pre-tokens that make up at least one
   MOST_COMMON-th of all are at most MOST_COMMON many; those of at most SHORT characters are joined by broadcast, which
   bounds it in bytes, too. The rest, rare or long, is joined by shuffle.

Added special tokens in a text (``<|endoftext|>``) are one token each and part the text, as the library does by default.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows get equal results; null ids pass through;
an empty table gives an empty result; other columns are ignored. Texts of any length are counted whole.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
MOST_COMMON = 2_000_000
SHORT = 24
#: Distinct pre-tokens, and characters of them, that a task adds up before it sends them on.
HELD, HELD_CHARS = 400_000, 32_000_000
#: The pattern of byte-level pre-tokenization, with the white space of the tokenizer library spelled out.
_SPACE = r"\t\n\x0B\f\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Tokenizer.from_file(path)


def _splitter(path: str | None) -> Callable[[str, Counter], int]:
    """A function that adds the pre-tokens of a text to a counter and returns how many added special tokens it has."""
    import regex

    special = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    part = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    find = regex.compile(PATTERN).findall

    def split(text: str, counts: Counter) -> int:
        if not part or not any(s in text for s in special):
            counts.update(find(text))
            return 0
        runs = part.split(text)
        for run in runs:
            counts.update(find(run))
        return len(runs) - 1

    return split


def _pieces(path: str | None):
    """(piece, seen) of all texts of a task, some hundred thousand at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts, chars = _splitter(path), Counter(), 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.large_string()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["piece", "seen"])

        for b in batches:
            for lo, hi in C.row_chunks(b.column(0)):
                for text in b.column(0).slice(lo, hi - lo).to_pylist():
                    split(text or "", counts)
                    chars += len(text or "") // 64  # most of a text is in pre-tokens met before
                if len(counts) > HELD or chars > HELD_CHARS:
                    yield flush()
                    counts, chars = Counter(), 0
        if counts:
            yield flush()

    return run


def _lengths(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for b in batches:
            for lo, hi in C.row_chunks(b.column(0), size=1 << 20):
                own = b.column(0).slice(lo, hi - lo)
                n = [len(e) for e in tokenizer.encode_batch_fast(own.to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([own, b.column(1).slice(lo, hi - lo), pa.array(n, pa.int64())], ["piece", "seen", "n"])

    return run


def _joined(path: str | None, common):
    """Bytes of each text, the tokens of its special tokens and common pre-tokens, and its other pre-tokens with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(path)
        known = dict(zip(common.value[0].to_pylist(), common.value[1].tolist(), strict=True))
        for b in batches:
            for lo, hi in C.row_chunks(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo)
                _, off = C.buffers(texts)
                total, cut, rest, freq = np.zeros(hi - lo, np.int64), [0], [], []
                for i, text in enumerate(texts.to_pylist()):
                    counts = Counter()
                    n = split(text or "", counts)
                    for piece, times in counts.items():
                        length = known.get(piece)
                        if length is None:
                            rest.append(piece)
                            freq.append(times)
                        else:
                            n += length * times
                    total[i] = n
                    cut.append(len(rest))
                cut = pa.array(cut, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(total), pa.ListArray.from_arrays(cut, pa.array(rest, pa.string())), pa.ListArray.from_arrays(cut, pa.array(freq, pa.int64()))],
                    ["doc_id", "n_bytes", "common", "rest", "freq"],
                )

    return run


def piece_lengths(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """(piece, seen, n): every distinct pre-token of the texts, how often it occurs and how many tokens it has."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_pieces(path), "piece string, seen long").groupBy("piece").agg(F.sum("seen").alias("seen"))
    return counted.mapInArrow(_lengths(path), "piece string, seen long, n long")


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_common: int = MOST_COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs; path: a byte-level tokenizer file."""
    spark = docs.sparkSession
    C.batch_rows(spark)
    pieces = C.materialize(piece_lengths(docs, path, text_col))
    seen = pieces.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    is_common = (F.col("seen") >= max(1, -(-seen // most_common))) & (F.length("piece") <= SHORT)
    table = pieces.where(is_common).select("piece", "n").limit(most_common).toArrow()
    common = spark.sparkContext.broadcast((table["piece"], table["n"].to_numpy()))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hot = rows.mapInArrow(_joined(path, common), "doc_id long, n_bytes long, common long, rest array<string>, freq array<long>")
    hot = C.materialize(hot.withColumn("row", F.monotonically_increasing_id()))
    rare = hot.select("row", F.explode(F.arrays_zip("rest", "freq")).alias("r")).select("row", F.col("r.rest").alias("piece"), F.col("r.freq").alias("times"))
    sums = rare.join(pieces.where(~is_common).select("piece", "n"), "piece").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"))
    n = F.col("common") + F.coalesce("more", F.lit(0))
    return hot.join(sums, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > LIMIT).alias("over_limit"))
