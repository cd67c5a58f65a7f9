"""Collocations: phrases of two to four words that stand together more often than their parts would.

Words are counted for each language, and those that occur LEAST times get a number: no phrase with a rarer word can be a
candidate. Texts become runs of numbers, broken at piece marks and at every other word. The n-grams of the runs are
packed into keys of 16 bytes (four numbers, first to last, 0 for none), sorted by radix and counted by runs of equal keys
within a task, dealt out by ranges of the key, sorted there and counted by runs again. Range bounds come from keys that
are sampled while texts are encoded; they say where a key is counted, never whether. Pairs come first. Longer keys are
packed only where all pairs within are frequent, by a bitmap of fixed size: pairs that share a bit cost work, no result.

Numbers are broadcast for the MOST_COMMON most frequent words of at most SHORT bytes; a larger dictionary is joined by
shuffle, for distinct words of a block of text. Scores are decimals. The best phrases of a language are chosen within
parts of it first, so no task holds a language.

Defined cases: null texts are empty; a null language counts as ``und``, with texts that say so; repeated rows and ids are
texts of their own; an empty table, or one without a frequent phrase, gives an empty result; other columns are ignored.
Only A-Z are lower-cased. Words may hold any bytes but space, tab and piece marks, control characters among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEAST = 30
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
#: A phrase goes if a longer one around it has this share of its places.
CONTAINED_PERCENT = 80
BREAKS = C.byte_set((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
GAPS = C.byte_set((0x20, 0x20), (0x09, 0x09))
#: Words whose numbers are broadcast: so many, of so many bytes with their language.
MOST_COMMON, SHORT = 1_000_000, 64
#: Numbers in a row of encoded text, about; keys sorted at once in a task; sampled keys for each row; rows sampled.
ROW, BLOCK, PROBES, SAMPLED = 8192, 1 << 22, 8, 20_000
#: Log of the bits that stand for frequent pairs (8 MB).
BITS = 26
U64 = np.uint64
KEYS = "part int, key binary, n long"
EMPTY = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


# -- words -----------------------------------------------------------------------------------------------------------


def _terms(texts: pa.Array, langs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Distinct ``word language`` terms of some texts, each word's place among them, where a word continues the run before it, and languages with their numbers of words."""
    data, off = C.buffers(texts)
    a = C._LOWER[data]
    breaks = BREAKS[a]
    word = ~(breaks | GAPS[a])
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = off[off < len(a)]
    first[inner] |= word[inner]
    starts = np.flatnonzero(first)
    names = langs.dictionary_encode()
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, bool), names.dictionary, np.zeros(len(names.dictionary), np.int64)
    doc = np.searchsorted(off, starts, side="right") - 1
    mark = np.cumsum(breaks)[starts]
    follows = np.zeros(len(starts), bool)
    follows[1:] = (mark[1:] == mark[:-1]) & (doc[1:] == doc[:-1])
    letters = a[word]
    ends = np.append(np.cumsum(word)[starts] - 1, len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
    lang = names.indices.to_numpy()[doc].astype(np.int64)
    u = len(words.dictionary)
    pair = lang * u + words.indices.to_numpy()
    if len(names.dictionary) * u <= 1 << 24:
        seen = np.zeros(len(names.dictionary) * u, bool)
        seen[pair] = True
        distinct = np.flatnonzero(seen)
        place = np.zeros(len(seen), np.int64)
        place[distinct] = np.arange(len(distinct))
        place = place[pair]
    else:
        distinct, place = np.unique(pair, return_inverse=True)
    terms = pc.binary_join_element_wise(words.dictionary.take(pa.array(distinct % u)), names.dictionary.take(pa.array(distinct // u)), " ")
    return terms, place, follows, names.dictionary, np.bincount(lang, minlength=len(names.dictionary))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of some texts; the term of an empty word counts all words of its language."""
    for b in batches:
        for lo, hi in C.row_chunks(b.column(0), size=8 << 20):
            terms, place, _, langs, n = _terms(b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo))
            totals = pc.binary_join_element_wise("", langs, " ")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([terms, totals]), pa.array(np.concatenate([np.bincount(place, minlength=len(terms)), n]))], ["term", "n"])


def dictionary(texts: DataFrame) -> DataFrame:
    """(term, n, id) of words that occur LEAST times in texts (text, lang), ids from 1; id 0: all words of a language."""
    counts = texts.mapInArrow(_counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = F.col("term").startswith(" ")
    words = C.materialize(counts.where((F.col("n") >= LEAST) | total).withColumn("m", F.monotonically_increasing_id()))
    words = words.withColumns({"task": F.shiftright("m", 33), "place": F.col("m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = words.groupBy("task").count().orderBy("task").collect()  # a row for each task
    offsets, at = [], 1
    for r in sizes:
        offsets.append((r["task"], at))
        at += r["count"]
    if at >= 1 << 31:
        raise ValueError("more than 2 ** 31 frequent words")
    tasks = words.sparkSession.createDataFrame(offsets, "task long, base long")
    return words.join(F.broadcast(tasks), "task").select("term", "n", F.when(total, 0).otherwise(F.col("base") + F.col("place")).alias("id"))


# -- texts as numbers ------------------------------------------------------------------------------------------------


def _rows(ids: np.ndarray) -> list[np.ndarray]:
    """Cuts of about ROW numbers at zeros, without runs of one number."""
    word = ids != 0
    near = np.zeros(len(ids), bool)
    near[:-1] |= word[1:]
    near[1:] |= word[:-1]
    ids = np.where(near, ids, 0)
    zero = ids == 0
    keep = np.ones(len(ids), bool)
    keep[1:] = ~(zero[1:] & zero[:-1])
    ids = ids[keep]
    zeros = np.flatnonzero(ids == 0)
    cuts, at = [], 0
    while at < len(ids):
        k = np.searchsorted(zeros, at + ROW)
        end = int(zeros[k]) + 1 if k < len(zeros) else len(ids)
        cuts.append(ids[at:end])
        at = end
    return cuts


def _probes(ids: np.ndarray) -> np.ndarray:
    """Some keys of a row, as pairs of numbers of 64 bits; numbers still unknown are left out."""
    ids = np.concatenate([np.maximum(ids, 0), np.zeros(3, ids.dtype)])
    i = np.arange(0, len(ids) - 3, max(1, (len(ids) - 3) // PROBES))
    i = i[(ids[i] > 0) & (ids[i + 1] > 0)]
    w = ids[i[:, None] + np.arange(4)].astype(U64)
    w[:, 3] *= w[:, 2] > 0
    return np.stack([w[:, 0] << U64(32) | w[:, 1], w[:, 2] << U64(32) | w[:, 3]], 1)


def _encoded(table, complete: bool):
    """Texts as numbers: 0 breaks a run, -k - 1 stands for term k of rest, which the broadcast table lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, numbers = table.value
        for b in batches:
            for lo, hi in C.row_chunks(b.column(0), size=8 << 20):
                own, place, follows, _, _ = _terms(b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo))
                at = pc.index_in(own, value_set=terms)
                found = at.is_valid().to_numpy(zero_copy_only=False)
                of = np.zeros(len(own), np.int32)
                of[found] = numbers[at.drop_null().to_numpy()]
                if not complete:
                    of[~found] = -np.flatnonzero(~found) - 1
                word = of[place]
                head = np.flatnonzero(~follows)
                ids = np.insert(word, head, 0) if len(head) else word
                cuts = _rows(ids)
                rest = []
                if not complete:
                    for k, cut in enumerate(cuts):
                        unknown, back = np.unique(cut[cut < 0], return_inverse=True)
                        cuts[k] = cut.copy()
                        cuts[k][cut < 0] = -back - 1
                        rest.append(own.take(pa.array(-unknown - 1)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.tobytes() for c in cuts], pa.binary()), pa.array(rest if rest else [[]] * len(cuts), pa.list_(pa.string())), pa.array([_probes(c).tobytes() for c in cuts], pa.binary())],
                    ["ids", "rest", "probe"],
                )

    return run


def _patched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for raw, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(raw, np.int32).copy()
            of = np.zeros(max(int(-ids.min(initial=0)), 1), np.int32)
            for hit in found or []:
                of[hit["k"]] = hit["id"]
            unknown = ids < 0
            ids[unknown] = of[-ids[unknown] - 1]
            out.append(ids.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(2)], ["ids", "probe"])


def encode(texts: DataFrame, words: DataFrame, most_common: int = MOST_COMMON) -> DataFrame:
    """(ids, probe): texts as runs of numbers, and some of their keys."""
    words = words.where("id > 0")
    n, seen = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    short = F.octet_length("term") <= SHORT
    common = short if n <= most_common else short & (F.col("n") >= -(-seen // most_common))
    table = words.where(common).select("term", "id").limit(most_common).toArrow()
    complete = len(table) == n
    shared = texts.sparkSession.sparkContext.broadcast((table["term"].combine_chunks(), table["id"].to_numpy().astype(np.int32)))
    rows = texts.mapInArrow(_encoded(shared, complete), "ids binary, rest array<string>, probe binary")
    if complete:
        return C.materialize(rows.select("ids", "probe"))
    rows = C.materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    asked = rows.select("row", F.posexplode("rest").alias("k", "term"))
    found = asked.join(words.where(~common).select("term", "id"), "term").groupBy("row").agg(F.collect_list(F.struct("k", "id")).alias("found"))
    return C.materialize(rows.join(found, "row", "left").select("ids", "found", "probe").mapInArrow(_patched, "ids binary, probe binary"))


# -- keys ------------------------------------------------------------------------------------------------------------


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by unsigned columns, the first counts most: one stable pass for each 16 bits that differ."""
    order = None
    for col in reversed(columns):
        for shift in range(0, 64, 16):
            digit = (col >> U64(shift)).astype(np.uint16)
            if len(digit) and digit.min() == digit.max():
                continue
            if order is None:
                order = np.argsort(digit, kind="stable")
            else:
                order = order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def _runs(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    order = radix_order([hi, lo])
    hi, lo = hi[order], lo[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    at = np.flatnonzero(new)
    return hi[at], lo[at], np.diff(np.append(at, len(hi)))


def _parts(hi: np.ndarray, lo: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The range of each of some sorted keys: how many bounds are at or below it."""
    starts = []
    for h, x in bounds:
        i, j = np.searchsorted(hi, U64(h), "left"), np.searchsorted(hi, U64(h), "right")
        starts.append(i + np.searchsorted(lo[i:j], U64(x), "left"))
    step = np.zeros(len(hi) + 1, np.int32)
    np.add.at(step, np.array(starts, np.int64), 1)
    return np.cumsum(step[:-1], dtype=np.int32)


def _packed(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    raw = np.stack([hi, lo], 1).astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(hi), [None, pa.py_buffer(raw)]).cast(pa.binary())


def slots(hi: np.ndarray) -> np.ndarray:
    return C.mix(hi) >> U64(64 - BITS)


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pairs of neighbours, and which are pairs of words."""
    w = ids.astype(U64)
    return w[:-1] << U64(32) | w[1:], (ids[:-1] > 0) & (ids[1:] > 0)


def _grams(ids: np.ndarray, bitmap: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs that start at the first most numbers; with a bitmap of pairs, of what is longer and has only such pairs within."""
    if len(ids) < 2:
        return np.zeros(0, U64), np.zeros(0, U64)
    hi, ok = _pairs(ids)
    if bitmap is None:
        hi = hi[:most][ok[:most]]
        return hi, np.zeros(len(hi), U64)
    at = np.flatnonzero(ok)
    slot = slots(hi[at])
    ok[at] = (bitmap[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1
    w = np.concatenate([ids.astype(U64), np.zeros(1, U64)])
    three = np.flatnonzero((ok[:-1] & ok[1:])[:most])
    ok = np.append(ok, False)
    four = three[ok[three + 2]]
    third = w[three + 2] << U64(32)
    return np.concatenate([hi[three], hi[four]]), np.concatenate([third, w[four + 2] << U64(32) | w[four + 3]])


def _keys(bounds, bitmap):
    """(part, key, n) of a task's n-grams, BLOCK at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            hi, lo, n = _runs(np.concatenate([h for h, _ in held]), np.concatenate([x for _, x in held]))
            return pa.RecordBatch.from_arrays([pa.array(_parts(hi, lo, bounds.value)), _packed(hi, lo), pa.array(n)], ["part", "key", "n"])

        for b in batches:
            data, off = C.buffers(b.column(0))
            ids = np.frombuffer(data, np.int32)
            ids = np.insert(ids, off[1:-1] // 4, 0)  # nothing runs from row to row
            for lo in range(0, len(ids), BLOCK):
                hi, rest = _grams(ids[lo : lo + BLOCK + LONGEST - 1], bits, BLOCK)
                held.append((hi, rest))
                size += len(hi)
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums n over runs of equal keys, which come in order."""
    last, held = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        data, _ = C.buffers(b.column(0))
        k = data.view(">u8").reshape(-1, 2)
        n = b.column(1).to_numpy()
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]).any(1)
        at = np.flatnonzero(new)
        sums = np.add.reduceat(n, at)
        keys = [(int(h), int(x)) for h, x in (k[at[0]], k[at[-1]])]
        if last == keys[0]:
            sums[0] += held
        elif last is not None:
            yield _frequent(np.array([last], U64), np.array([held]))
        yield _frequent(k[at[:-1]].astype(U64), sums[:-1])
        last, held = keys[1], int(sums[-1])
    if last is not None:
        yield _frequent(np.array([last], U64), np.array([held]))


def _frequent(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    keep = n >= LEAST
    k = k[keep].reshape(-1, 2)
    return pa.RecordBatch.from_arrays([_packed(k[:, 0], k[:, 1]), pa.array(n[keep], pa.int64())], ["key", "a"])


def _bounds(encoded: DataFrame, parts: int) -> list[tuple[int, int]]:
    """At most parts - 1 keys that cut the sampled distinct ones into even ranges; the sample is bounded."""
    rows = max(encoded.count(), 1)
    drawn = encoded.select("probe").sample(min(1.0, SAMPLED / rows), seed=5).limit(2 * SAMPLED).toArrow()["probe"]
    raw = np.frombuffer(b"".join(drawn.to_pylist()), U64).reshape(-1, 2)
    keys = sorted({(h, x) for h, x in raw.tolist()})
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def _bitmap(pairs: DataFrame) -> bytes:
    """A bit for each pair that is frequent; its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, _ = C.buffers(b.column(0))
            slot = slots(data.view(">u8").reshape(-1, 2)[:, 0].astype(U64))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> U64(6)).astype(np.int64)), pa.array((U64(1) << (slot & U64(63))).view(np.int64))], ["at", "bits"])

    found = pairs.select("key").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def frequent_ngrams(encoded: DataFrame) -> DataFrame:
    """(key, a) of all n-grams of two to LONGEST numbers that occur LEAST times."""
    spark = encoded.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = spark.sparkContext.broadcast(_bounds(encoded, parts))

    def counted(bitmap) -> DataFrame:
        keys = encoded.select("ids").mapInArrow(_keys(bounds, bitmap), KEYS)
        dealt = keys.repartitionById(parts, "part").select("key", "n").sortWithinPartitions("key")
        return C.materialize(dealt.mapInArrow(_summed, "key binary, a long"))

    pairs = counted(None)
    return pairs.unionByName(counted(spark.sparkContext.broadcast(_bitmap(pairs))))


# -- phrases ---------------------------------------------------------------------------------------------------------


def _slice(key: Column, first: Column, n: Column) -> Column:
    """Words first .. first + n - 1 of a key, as a key."""
    return F.rpad(F.substring(key, first * 4 + 1, n * 4), 16, F.lit(bytearray(1)))


def _scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """(key, size, a, l, r, score) of each candidate, by its lowest-scoring cut."""
    parts = grams.unionByName(words.where("id > 0").select(F.unhex(F.concat(F.lpad(F.hex("id"), 8, "0"), F.lit("0" * 24))).alias("key"), F.col("n").alias("a")))
    cuts = grams.withColumn("size", _size()).select("key", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _slice(F.col("key"), F.lit(0), F.col("k")), "rest": _slice(F.col("key"), F.col("k"), F.col("size") - F.col("k"))})
    cuts = cuts.join(parts.select(F.col("key").alias("first"), F.col("a").alias("l")), "first").join(parts.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest")
    score = F.expr(f"cast({SCALE} as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "a", "size")).alias("best"))
    return best.select("key", "best.size", "best.a", "best.l", "best.r", "best.score")


def _size() -> Column:
    """Words in a key of two to four."""
    none = bytearray(4)
    return F.when(F.substring("key", 9, 4) == F.lit(none), 2).when(F.substring("key", 13, 4) == F.lit(none), 3).otherwise(4)


def _kept(grams: DataFrame) -> DataFrame:
    """Keys of candidates that no longer one contains with CONTAINED_PERCENT of their places."""
    longer = grams.withColumn("size", _size()).where("size > 2")
    inner = longer.select("a", "key", F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m), f -> struct(f, m))))")).alias("p"))
    inner = inner.select(_slice(F.col("key"), F.col("p.f"), F.col("p.m")).alias("key"), F.col("a").alias("around")).groupBy("key").agg(F.max("around").alias("around"))
    wide = lambda c: F.col(c).cast("decimal(19, 0)")
    goes = F.lit(100).cast("decimal(3, 0)") * wide("around") >= F.lit(CONTAINED_PERCENT).cast("decimal(3, 0)") * wide("a")
    return grams.join(inner, "key", "left").where(F.col("around").isNull() | ~goes).select("key")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, most_common: int = MOST_COMMON) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first top phrases of each language."""
    spark = docs.sparkSession
    C.batch_rows(spark)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    words = dictionary(texts)
    grams = frequent_ngrams(encode(texts, words, most_common))
    scored = C.materialize(_scored(grams, words).join(_kept(grams), "key", "left_semi"))

    named = words.select("id", F.expr("substring(term, 1, instr(term, ' ') - 1)").alias("word"), F.expr("substring(term, instr(term, ' ') + 1)").alias("lang"), "n")
    at = scored.select("key", "size", F.posexplode(F.expr("transform(sequence(0, size - 1), i -> conv(hex(substring(key, 4 * i + 1, 4)), 16, 10))")).alias("place", "id"))
    spelled = at.select("key", "place", F.col("id").cast("long").alias("id")).join(named.where("id > 0").select("id", "word", "lang"), "id")
    spelled = spelled.groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.expr("transform(array_sort(collect_list(struct(place, word))), x -> x.word)"), " ").alias("phrase"))
    rows = scored.join(spelled, "key")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(parts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = named.where("id = 0").select("lang", "n")
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
