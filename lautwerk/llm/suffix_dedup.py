"""Removal of repeated passages: a byte goes if a string of SPAN bytes around it starts earlier, too.

A suffix array of the corpus would show it: suffixes that agree in SPAN bytes stand together. It is never built whole.
Suffixes are dealt out by what they have in common, and Burrows-Wheeler transforms of shards are merged piece by piece:

1. Every window of SPAN bytes has an anchor, the place of its smallest hash of GRAM bytes (leftmost of several), so equal
   windows have equal anchors in equal places. Neighbouring windows with one anchor are a segment. A task folds equal
   segments and passes on one of each.
2. Segments meet by anchor. Of equal ones all but the earliest are repeats. Where different ones are left, their texts are asked for.
3. A task that cuts the texts of some documents is a shard: it sorts its suffixes, which start at anchors, and gives
   with each what precedes it. Shards of an anchor are merged by refining their interleave: starting from shard after shard, places
   are dealt stably by one symbol after another within blocks of equal beginnings, so a shard keeps its order and no
   suffix is sorted again. Where a block splits is the common prefix of two neighbours.
4. The transform then steps to the left: dealt stably by the preceding symbol, the order of suffixes becomes that of
   suffixes one byte longer. After i steps, intervals of suffixes that agree in these i symbols and in SPAN - i symbols
   to the right are repeated windows; all but the earliest of each are repeats.

Anchors that a bounded sample of the documents finds in a large share of segments don't go to one task: their windows
are dealt out by all their bytes, each on its own. That is exact, too, and only says where windows meet. Spans are gathered for
each document and its bytes are taken out; documents without a span don't go through that shuffle with their texts.

Defined cases: null texts are empty, and texts under SPAN bytes keep all; a null id comes before all others; rows that share an id
count one after another, as the table gives them; an empty table gives an empty result; other columns are ignored.
Matches are of bytes, so a character may lose a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN = 100
GRAM = 32
#: Grams of a window; a segment has as many windows at most.
WIDTH = SPAN - GRAM + 1
#: Bytes looked at in one go; segments folded at once; rows merged at once, about.
PIECE, HELD, ROWS = 1 << 20, 1 << 21, 1 << 16
#: Log of the bits that stand for documents (8 MB).
BITS = 26
#: Documents sampled for heavy anchors, and segments that such an anchor has there at least.
SAMPLED, LEAST_HEAVY = 2000, 50
#: Stands after the end of a segment; no byte of UTF-8.
END = 0xFF
U64 = np.uint64
_BASE = np.array([0x9E3779B97F4A7C15], U64)
SEGMENTS = "anchor long, segment long, shape int, id long, row long, start long"
SPANS = "id long, row long, start long, stop long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# -- windows ---------------------------------------------------------------------------------------------------------


def _gram_hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the 32 and of the 64 bytes that start at each place where so many are left."""
    h, base, n = C._BYTE[a], _BASE, 1
    while n < 64:
        short = h
        h = h[:-n] * base + h[n:]
        base, n = base * base, 2 * n
    return short, h


def segments(a: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of texts that stand side by side, at cut[k]:cut[k + 1]: anchor hash, own hash, first and last window, anchor place, text."""
    h32, h64 = _gram_hashes(a)
    mask = U64((1 << 22) - 1)
    key = (h32 * U64(0xBF58476D1CE4E5B9) & ~mask) | np.arange(len(h32), dtype=U64)
    step = 1
    while 2 * step <= WIDTH:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    key = np.minimum(key[: len(key) - (WIDTH - step)], key[WIDTH - step :])
    at = (key & mask).astype(np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    new[cut[:-1]] = True
    ends = cut[1:] - SPAN + 1  # the first window that runs over the end of its text
    new[ends[ends < len(new)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    text = np.searchsorted(cut, first, side="right") - 1
    own = first < ends[text]
    first, last, text = first[own], last[own], text[own]
    return *_named(h32, h64, at[first], first, last), first, last, at[first], text


def _named(h32: np.ndarray, h64: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of anchors, and of segments: three spans of 64 bytes cover all that one can have."""
    stop = last + SPAN
    middle = np.minimum(first + 52, stop - 64)
    own = h64[first] * U64(0x94D049BB133111EB) + h64[middle] * U64(0xD6E8FEB86659FD93) + h64[stop - 64]
    return C.mix(h32[at]), C.mix(own)


def _side_by_side(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """About PIECE bytes at a time: bytes, cuts, and document and place in it of what stands between cuts. A long text is cut into parts that share SPAN - 1 bytes."""
    lanes = []
    for k in np.flatnonzero(np.diff(off) >= SPAN).tolist():
        lo, end = int(off[k]), int(off[k + 1])
        while lo + SPAN <= end:
            hi = min(lo + PIECE + SPAN - 1, end)
            lanes.append((k, lo, hi))
            lo = hi - SPAN + 1
    held, size = [], 0
    for n, lane in enumerate(lanes):
        held.append(lane)
        size += lane[2] - lane[1]
        if size >= PIECE or n + 1 == len(lanes):
            yield (
                np.concatenate([data[lo:hi] for _, lo, hi in held]), np.cumsum([0] + [hi - lo for _, lo, hi in held]),
                np.array([k for k, _, _ in held]), np.array([lo - int(off[k]) for k, lo, _ in held]),
            )
            held, size = [], 0


def _split_heavy(a: np.ndarray, heavy: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Segments of heavy anchors as single windows, each named by the hash of all its bytes."""
    anchor, own, first, last, at, text = found
    hot = np.isin(anchor, heavy)
    if not hot.any():
        return found
    n = (last - first + 1)[hot]
    which = np.repeat(np.flatnonzero(hot), n)
    window = np.repeat(first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    _, name = _named(*_gram_hashes(a), at[which], window, window)
    parts = ((anchor, C.mix(name)), (own, name), (first, window), (last, window), (at, at[which]), (text, text[which]))
    out = [np.concatenate([x[~hot], y]) for x, y in parts]
    order = np.argsort(out[2], kind="stable")
    return tuple(x[order] for x in out)


def _folded(heavy: np.ndarray):
    """One segment of all equal ones, and spans of the others, for HELD segments of a task at a time; a span has shape -1 and its end for a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            anchor, own, shape, ids, row, start = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort([start, row, ids])
            name = C.mix(anchor ^ C.mix(own + shape.astype(U64)))[order]
            order = order[np.argsort(name, kind="stable")]
            anchor, own, shape, ids, row, start = (x[order] for x in (anchor, own, shape, ids, row, start))
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | (shape[1:] != shape[:-1])
            i, r, lo, hi = _joined(ids[~new], row[~new], start[~new], start[~new] + SPAN + (shape[~new] & 0xFF))
            spread = C.mix(i.astype(U64) ^ C.mix(lo.astype(U64)))
            columns = (
                np.concatenate([anchor[new], spread]).view(np.int64), np.concatenate([own[new].view(np.int64), hi]), np.concatenate([shape[new], np.full(len(i), -1)]).astype(np.int32),
                np.concatenate([ids[new], i]), np.concatenate([row[new], r]), np.concatenate([start[new], lo]),
            )
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "segment", "shape", "id", "row", "start"])

        for b in batches:
            for lo, hi in C.row_chunks(b.column(2)):
                data, off = C.buffers(b.column(2).slice(lo, hi - lo))
                ids, rows = b.column(0).to_numpy()[lo:hi], b.column(1).to_numpy()[lo:hi]
                for a, cut, doc, place in _side_by_side(data, off):
                    anchor, own, first, last, at, text = _split_heavy(a, heavy, segments(a, cut))
                    k = doc[text]
                    held.append((anchor, own, (at - first) << 8 | last - first, ids[k], rows[k], first - cut[text] + place[text]))
                    size += len(anchor)
                    if size >= HELD:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    return run


def _joined(ids: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans that overlap or touch, put together."""
    if not len(ids):
        return ids, row, start, stop
    order = np.lexsort([start, row, ids])
    ids, row, start, stop = ids[order], row[order], start[order], stop[order]
    doc = np.ones(len(ids), bool)
    doc[1:] = (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])
    # the furthest end so far within a document: ends fall in with documents, whose numbers rise
    reach = np.maximum.accumulate(stop + np.cumsum(doc) * (int(stop.max()) + 1)) - np.cumsum(doc) * (int(stop.max()) + 1)
    new = doc.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return ids[at], row[at], start[at], reach[np.append(at[1:], len(ids)) - 1]


# -- segments that meet by anchor ------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """About most rows at a time, all rows of an anchor (column 0, in order) together."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < most:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        anchor = whole.column(0).to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            yield whole.slice(0, cut)
            whole = whole.slice(cut)
        held, size = [whole], whole.num_rows
        if size >= most:
            most = 2 * size  # one anchor goes on
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of segments that have an earlier equal one, and the earliest of each where an anchor has several different ones."""
    for b in _blocks(batches, ROWS):
        anchor, own, shape, ids, row, start = (c.to_numpy() for c in b.columns)
        span = shape < 0
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | (shape[1:] != shape[:-1]) | span[1:] | span[:-1]
        again = ~new
        spans = _joined(np.concatenate([ids[span], ids[again]]), np.concatenate([row[span], row[again]]), np.concatenate([start[span], start[again]]), np.concatenate([own[span], start[again] + SPAN + (shape[again] & 0xFF)]))
        left = np.flatnonzero(new & ~span)
        other = anchor[left[1:]] == anchor[left[:-1]]
        several = np.zeros(len(left), bool)
        several[1:] |= other
        several[:-1] |= other
        left = left[several]
        columns = (
            np.concatenate([np.zeros(len(spans[0]), np.int64), anchor[left]]), np.concatenate([np.full(len(spans[0]), -1, np.int32), shape[left].astype(np.int32)]),
            *(np.concatenate([x, y[left]]) for x, y in zip(spans[:3], (ids, row, start), strict=True)), np.concatenate([spans[3], np.zeros(len(left), np.int64)]),
        )
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "shape", "id", "row", "start", "stop"])


# -- Burrows-Wheeler transforms --------------------------------------------------------------------------------------


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the segments asked for: what follows from the anchor on, in this shard's order, and what precedes it, nearest first."""
    for n, b in enumerate(batches):
        data, off = C.buffers(b.column(2))
        asked = b.column(3).combine_chunks() if isinstance(b.column(3), pa.ChunkedArray) else b.column(3)
        many = np.diff(asked.offsets.to_numpy())
        each = np.repeat(np.arange(len(many)), many)
        hits = asked.flatten()
        anchor, shape, start = (hits.field(k).to_numpy() for k in ("anchor", "shape", "start"))
        lo = off[each] + start
        mid, hi = lo + (shape >> 8), lo + SPAN + (shape & 0xFF)
        right = [data[i:j].tobytes() for i, j in zip(mid.tolist(), hi.tolist(), strict=True)]
        left = [data[i:j][::-1].tobytes() for i, j in zip(lo.tolist(), mid.tolist(), strict=True)]
        order = sorted(range(len(right)), key=lambda k: (anchor[k], right[k]))
        shard = (b.column(4).to_numpy()[each] << 32) + n
        take = pa.array(order, pa.int64())
        columns = [anchor, shard, None, b.column(0).to_numpy()[each], b.column(1).to_numpy()[each], start + (shape >> 8)]
        arrays = [pa.array(np.arange(len(order), dtype=np.int64)) if c is None else pa.array(c).take(take) for c in columns]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([left[k] for k in order], pa.binary()), pa.array([right[k] for k in order], pa.binary())], ["anchor", "shard", "place", "id", "row", "at", "left", "right"])


def _matrix(arr: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows that END fills up, and their lengths."""
    data, off = C.buffers(arr)
    n = np.diff(off)
    out = np.full((len(n), width), END, np.uint8)
    out[np.arange(width) < n[:, None]] = data
    return out, n


def interleave(group: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges shards: the order of suffixes within each group, and how much each has in common with the one before it (-1: starts a group).

    Rows come by group (rising numbers), shard after shard. A place is dealt again, stably, as long as its block of equal beginnings has others.
    """
    n = len(group)
    at, common = np.arange(n), np.full(n, right.shape[1])
    block = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) if n else np.zeros(0, np.int64)
    common[np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))] = -1 if n else 0
    live = np.flatnonzero(np.bincount(block)[block] > 1) if n else at
    block = block[live]
    for h in range(right.shape[1]):
        if not len(live):
            break
        key = block << 8 | right[at[live], h]
        order = np.argsort(key, kind="stable")
        at[live] = at[live][order]
        key = key[order]
        split = np.concatenate([[False], key[1:] != key[:-1]])
        fresh = live[split]
        common[fresh] = np.where(common[fresh] < 0, -1, np.minimum(common[fresh], h))
        block = np.cumsum(split)
        more = np.bincount(block)[block] > 1
        live, block = live[more], block[more]
    return at, common


def repeated_windows(group: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, age: np.ndarray) -> np.ndarray:
    """For each row and i < WIDTH: whether the window that starts i bytes before the anchor is also that of an older row of the group."""
    at, common = interleave(group, right)
    out = np.zeros((len(group), WIDTH), bool)
    place, label = np.arange(len(at)), np.zeros(len(at), np.int64)
    for i in range(WIDTH):
        if i:
            symbol = left[at[place], i - 1]
            goes_on = n_left[at[place]] >= i
            place, label, symbol = place[goes_on], label[goes_on], symbol[goes_on]
            order = np.argsort(symbol, kind="stable")
            place, label, symbol = place[order], label[order], symbol[order]
            if not len(place):
                break
            label = np.concatenate([[0], np.cumsum((symbol[1:] != symbol[:-1]) | (label[1:] != label[:-1]))])
        whole = n_right[at[place]] >= SPAN - i
        own, mine = place[whole], label[whole]
        if not len(own):
            continue
        alike = np.cumsum(common < SPAN - i)[own]
        new = np.concatenate([[True], (alike[1:] != alike[:-1]) | (mine[1:] != mine[:-1])])
        ages = age[at[own]]
        oldest = np.minimum.reduceat(ages, np.flatnonzero(new))
        out[at[own], i] = ages > oldest[np.cumsum(new) - 1]
    return out


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that an older segment of the same anchor has, too."""
    for b in _blocks(batches, ROWS):
        anchor, ids, row, at = (b.column(k).to_numpy() for k in (0, 3, 4, 5))
        age = np.empty(len(at), np.int64)
        age[np.lexsort([at, row, ids])] = np.arange(len(at))
        left, n_left = _matrix(b.column(6), WIDTH - 1)
        right, n_right = _matrix(b.column(7), SPAN)
        found = repeated_windows(anchor, left, n_left, right, n_right, age)[:, ::-1]
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (r, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        base = at[r] - WIDTH + 1
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _joined(ids[r], row[r], base + lo, base + hi - 1 + SPAN)], ["id", "row", "start", "stop"])


# -- documents -------------------------------------------------------------------------------------------------------


def _slot() -> Column:
    return F.shiftrightunsigned(F.xxhash64("id", "row"), 64 - BITS)


def _documents_of(rows: DataFrame):
    """A bit for each document among rows, of a fixed size, broadcast; others may share it."""
    bits = rows.select(_slot().alias("s")).select(F.shiftright("s", 6).alias("at"), F.expr("shiftleft(1L, cast(s & 63 AS int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(out)


def _has(bits, slot: np.ndarray) -> np.ndarray:
    return bits.value[slot >> 6] >> (slot & 63) & 1 > 0


def _wanted(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1, 2]).filter(pa.array(_has(bits, b.column(3).to_numpy())))

    return run


def _plain(bits):
    """Result of documents without spans; the texts of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = _has(bits, b.column(3).to_numpy())
            data, off = C.buffers(b.column(2))
            digest = [None if h else hashlib.sha256(data[i:j]).hexdigest() for h, i, j in zip(hit.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]
            text = pa.array([data[i:j].tobytes() if h else None for h, i, j in zip(hit.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(4), b.column(0), b.column(1), pa.array(np.diff(off)), pa.array(digest, pa.string()), text], ["doc_id", "id", "row", "n_bytes", "digest", "bytes"])

    return run


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digest, texts, spans = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
        removed, runs = [], []
        for k, text in enumerate(texts):
            lo, hi = np.array([(s["start"], s["stop"]) for s in spans[k] or ()], np.int64).reshape(-1, 2).T
            zero = np.zeros(len(lo), np.int64)
            _, _, lo, hi = _joined(zero, zero, lo, hi)
            removed.append(int((hi - lo).sum()))
            runs.append(len(lo))
            if text is not None:
                cuts = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(text)]
                digest[k] = hashlib.sha256(b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True))).hexdigest()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, row, text): id and row together tell rows apart and put them in order; null is the smallest id."""
    ids = F.col(id_col).cast("long")
    out = docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(-(1 << 63)).cast("long")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if out.groupBy("id").count().where("count > 1").isEmpty():
        return out.withColumn("row", F.lit(0).cast("long"))
    return C.materialize(out.withColumn("row", F.monotonically_increasing_id()))


def _heavy(rows: DataFrame, parts: int, least: int) -> np.ndarray:
    """Anchors with a large share of the different segments of a sample: fewer than 4 for each part."""
    sample = rows.sample(min(1.0, SAMPLED / max(rows.count(), 1)), seed=3).limit(2 * SAMPLED)
    found = sample.mapInArrow(_folded(np.zeros(0, U64)), SEGMENTS).where("shape >= 0").groupBy("anchor", "segment", "shape").count().groupBy("anchor").count()
    found = C.materialize(found)
    total = found.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    heavy = found.where(F.col("count") >= max(least, total // (4 * parts))).select("anchor").toArrow()["anchor"].to_numpy()
    return heavy.view(U64)


def repeats(rows: DataFrame, least_heavy: int = LEAST_HEAVY) -> DataFrame:
    """(id, row, start, stop): spans of rows (id, row, text) whose bytes are in a window that starts earlier, too. They may overlap."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    own = rows.select("id", "row", "text")
    folded = own.mapInArrow(_folded(_heavy(own, parts, least_heavy)), SEGMENTS)
    dealt = folded.repartition(parts, "anchor").sortWithinPartitions("anchor", "segment", "shape", "id", "row", "start")
    met = C.materialize(dealt.mapInArrow(_met, "anchor long, shape int, id long, row long, start long, stop long"))

    asked = met.where("shape >= 0")
    texts = own.withColumn("slot", _slot()).mapInArrow(_wanted(_documents_of(asked)), "id long, row long, text string")
    asked = asked.groupBy("id", "row").agg(F.collect_list(F.struct("anchor", "shape", "start")).alias("asked"))
    cut = texts.join(asked, ["id", "row"]).select("id", "row", "text", "asked", F.spark_partition_id().cast("long").alias("task"))
    shards = cut.mapInArrow(_shards, "anchor long, shard long, place long, id long, row long, at long, left binary, right binary")
    dealt = shards.repartition(parts, "anchor").sortWithinPartitions("anchor", "shard", "place")
    return met.where("shape < 0").select("id", "row", "start", "stop").unionByName(dealt.mapInArrow(_transformed, SPANS))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_heavy: int = LEAST_HEAVY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of docs."""
    C.batch_rows(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    spans = C.materialize(repeats(rows, least_heavy).groupBy("id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    plain = rows.select("id", "row", "text", _slot().alias("slot"), "doc_id").mapInArrow(_plain(_documents_of(spans)), "doc_id long, id long, row long, n_bytes long, digest string, bytes binary")
    return plain.join(spans, ["id", "row"], "left").select("doc_id", "n_bytes", "digest", "bytes", "spans").mapInArrow(_without_spans, RESULT)
