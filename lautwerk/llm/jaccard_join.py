"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Plan

1. ``Hot list``: shingles in many texts, counted over all texts chunk by chunk. It only sets the order of a text's
   shingles (common ones last, else by hash), never what is compared; any order common to all texts is exact.
2. ``Prefixes``: two sets with Jaccard >= t share one of the first n - ceil(t * n) + 1 shingles of that order, so
   only those are dealt out by shingle. Texts with equal sets are one class from here on.
3. ``Contraction``: every class is compared exactly with three leaders of each of its tiles. That is linear in the
   size of a tile and merges groups of copies before pairs are looked at.
4. ``Tiles``: classes of one shingle that are still in different components meet in a join, each with those of its
   size band and of the next; bands are part of the condition, so that no row is sent twice. The rest of it is the
   bitmap bound: each bit set on one side only is an element the other side lacks, so bit counts bound the overlap
   from above. Large tiles are split into salted blocks. Only pairs that pass leave the join.
5. ``Verification``: exact intersection of the sorted arrays of 64-bit shingle hashes.
6. Components over the verified links, with alternating star contraction on the cluster.

Links between texts in one component need not all be listed: no component is lost by skipping a pair whose ends are
already connected. ``jaccard_links`` skips none: it goes through the tiles without contraction and returns every link
between different sets, with the classes of equal sets that the rows belong to.

Defined cases: null or empty text has no shingles and is linked with nothing; fewer than five words make one shingle;
rows with equal doc_id are separate rows with the same label; a null doc_id is never the smallest of a component
unless all its ids are null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A shingle counts as common from so many texts on, or from as many more as keep the list of common ones this short.
HOT_LEAST = 8
HOT_MOST = 500_000
TILE_LONGS = 8
BLOCK = 2048
#: A side of so many ids is broadcast, a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _chunk_counts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs = [], 0

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], ["token", "seen"])

        for b in batches:
            for lo, hi in C.row_chunks(b.column(0)):
                h, _, cut = C.word_hashes(b.column(0).slice(lo, hi - lo))
                held.append(_raw_shingles(h, cut, k))
                docs += hi - lo
                if docs >= 4096 or sum(map(len, held)) > 4_000_000:
                    yield flush()
                    held, docs = [], 0
        if held:
            yield flush()

    return run


def _raw_shingles(h: np.ndarray, cut: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes of several texts, repeats within a text included; short texts are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * C._STEP[0]
    for j in range(1, k):
        out = out + h[j : n + j] * C._STEP[j]
    left = np.repeat(cut[1:], np.diff(cut))[:n] - np.arange(n)  # words to the end of the own text
    return C.mix(out[left >= k])


def _prefixes(k: int, percent: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = hot.value
        seen: set[int] = set()
        for b in batches:
            ids = b.column(0)
            for lo, hi in C.row_chunks(b.column(1)):
                h, _, cut = C.word_hashes(b.column(1).slice(lo, hi - lo))
                gid, size, pre, maps, tile = [], [], [], [], []
                for i in range(hi - lo):
                    s = C.shingles(h[cut[i] : cut[i + 1]], k)
                    n = len(s)
                    size.append(n)
                    g = _gid(s) if n else None
                    gid.append(g)
                    if g is None or g in seen:
                        pre.append(None)
                        maps.append(None)
                        tile.append(None)
                        continue
                    maps.append(_bitmap(s, 1 << max(0, (2 * n - 1).bit_length() - 6)))
                    tile.append(_bitmap(s, TILE_LONGS))
                    if len(seen) < 2_000_000:
                        seen.add(g)
                    p = n + (-percent * n) // 100 + 1
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        is_hot = common[at] == s
                        if is_hot[:p].any():
                            s = np.concatenate([s[~is_hot], s[is_hot]])
                    pre.append(s[:p].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(gid, pa.int64()), pa.array(size, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (pre, maps, tile))],
                    ["doc_id", "gid", "n", "prefix", "bitmap", "tile_map"],
                )

    return run


def _bitmap(s: np.ndarray, longs: int) -> np.ndarray:
    """Bits at the hashes modulo the width; of two widths the larger folds onto the smaller one."""
    bits = np.zeros(longs * 64, np.uint8)
    bits[(s >> C.U64(20)) % C.U64(longs * 64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _gid(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in C.row_chunks(b.column(0)):
                h, _, cut = C.word_hashes(b.column(0).slice(lo, hi - lo))
                gid, toks = [], []
                for i in range(hi - lo):
                    s = C.shingles(h[cut[i] : cut[i + 1]], k)
                    if not len(s):
                        continue
                    gid.append(_gid(s))
                    toks.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(toks, pa.binary())], ["gid", "toks"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            xs, ys = b.column(2), b.column(3)
            for i in range(b.num_rows):
                x, y = np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["src", "dst"])

    return run


def _folded(x: str, y: str) -> Column:
    """Bitmap x at the width of y where it is twice as wide."""
    n = F.size(y)
    return F.when(F.size(x) > n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseOR(q))).otherwise(F.col(x))


def _lacks(x: str, y: str) -> Column:
    """How many bits x has that y lacks."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda a, v: a + v)


def _close(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class _Join:
    """Classes of equal sets, their prefixes dealt out by shingle, and the tests that pairs go through."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int):
        spark = docs.sparkSession
        C.batch_rows(spark)
        self.k, self.percent = k, percent
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

        # 1. shingles that many texts share
        counted = self.docs.select("text").mapInArrow(_chunk_counts(k), "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen"))
        seen = C.materialize(counted.where(F.col("seen") >= HOT_LEAST))
        by_size = {r["size"]: r["count"] for r in seen.groupBy(F.floor(F.log2("seen")).alias("size")).count().collect()}
        size = int(np.log2(HOT_LEAST))
        while sum(n for k_, n in by_size.items() if k_ >= size) > HOT_MOST:
            size += 1
        hot = seen.where(F.col("seen") >= 2**size).select("token").toArrow()["token"].to_numpy()
        hot = spark.sparkContext.broadcast(np.sort(hot.astype(np.int64).view(np.uint64)))

        # 2. prefixes; a task leaves out classes that it has met, so a class comes at most once from each task
        rows = self.docs.mapInArrow(_prefixes(k, percent, hot), "doc_id long, gid long, n long, prefix array<long>, bitmap array<long>, tile_map array<long>")
        self.rows = C.materialize(rows)
        self.classes = self.rows.where("gid is not null").groupBy("gid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
        postings = self.rows.where("prefix is not null").select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token"))
        tiles = postings.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token")
        self.shared = C.materialize(postings.join(tiles.hint("merge"), "token").distinct())
        self.maps = self.rows.where("bitmap is not null").select("gid", "n", "bitmap")

    def possible(self, p: DataFrame) -> DataFrame:
        """Pairs that their bitmaps, as wide as their size bands ask for, allow to be links."""
        one = p.join(self.maps.select(F.col("gid").alias("a"), F.col("n").alias("a_n"), F.col("bitmap").alias("x")), "a")
        two = one.join(self.maps.select(F.col("gid").alias("b"), F.col("n").alias("b_n"), F.col("bitmap").alias("y")), "b")
        two = two.select("a", "b", "a_n", "b_n", _folded("x", "y").alias("x"), _folded("y", "x").alias("y"))
        two = two.select("a", "b", "a_n", "b_n", _lacks("x", "y").alias("a_only"), _lacks("y", "x").alias("b_only"))
        bound = F.least(F.col("a_n") - F.col("a_only"), F.col("b_n") - F.col("b_only"))
        # the maps of a class may come from several tasks
        return two.where((100 + self.percent) * bound >= self.percent * (F.col("a_n") + F.col("b_n"))).select("a", "b").distinct()

    def verified(self, p: DataFrame) -> DataFrame:
        """Links among the pairs, by exact intersection; sets are made again from the texts that the pairs name."""
        p = C.materialize(p)
        ids = p.select(F.col("a").alias("gid")).union(p.select(F.col("b").alias("gid"))).distinct()
        wanted = C.materialize(ids.join(self.classes.select("gid", "first_id"), "gid"))
        few = wanted.count() <= BROADCAST_ROWS
        side = (lambda d: F.broadcast(d)) if few else (lambda d: d)
        chosen = self.docs.join(side(wanted.select("first_id")), self.docs["doc_id"].eqNullSafe(F.col("first_id")), "left_semi").select("text")
        sets = C.materialize(chosen.mapInArrow(_sets(self.k), "gid long, toks binary").join(side(wanted.select("gid")), "gid", "left_semi"))
        one = p.join(sets.select(F.col("gid").alias("a"), F.col("toks").alias("x")), "a")
        two = one.join(sets.select(F.col("gid").alias("b"), F.col("toks").alias("y")), "b").select("a", "b", "x", "y")
        return two.mapInArrow(_exact(self.percent), "src long, dst long")

    def led(self) -> DataFrame:
        """Pairs (a, b) of each class with the leaders of its tiles."""
        copies = self.classes.where("copies > 1").select("gid", "copies")
        ranked = self.shared.join(copies, "gid", "left").select("token", "gid", "n", "at", F.coalesce("copies", F.lit(1)).alias("copies"))
        by = [F.struct("copies", "gid", "n", "at"), F.struct(F.xxhash64("gid", F.lit(1)), "gid", "n", "at"), F.struct(F.xxhash64("gid", F.lit(2)), "gid", "n", "at")]
        leaders = ranked.groupBy("token").agg(*(F.max(s).alias(f"m{i}") for i, s in enumerate(by)))
        leaders = leaders.select("token", F.array_distinct(F.array(*(F.struct(f"m{i}.gid", f"m{i}.n", f"m{i}.at") for i in range(3)))).alias("led"))
        pairs = self.shared.join(leaders, "token").select("gid", "n", "at", F.explode("led").alias("led"))
        close = _close(F.col("n"), F.col("led.n"), self.percent) & _reach(F.col("n"), F.col("at"), F.col("led.n"), F.col("led.at"), self.percent)
        return pairs.where((F.col("gid") != F.col("led.gid")) & close).select(F.greatest("gid", "led.gid").alias("a"), F.least("gid", "led.gid").alias("b")).distinct()

    def tiled(self, apart: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes in different components that meet in a tile and pass its bounds; apart: shared with component."""
        open_tiles = apart.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / self.percent))).cast("int")
        tile_maps = self.rows.where("tile_map is not null").select("gid", "tile_map")
        bits = [f"b{i}" for i in range(TILE_LONGS)]
        member = apart.join(open_tiles.select("token", blocks.alias("blocks")), "token").join(tile_maps, "gid")
        member = C.materialize(member.select("token", "gid", "n", "at", "component", "blocks", band.alias("band"), *(F.col("tile_map")[i].alias(b) for i, b in enumerate(bits))))
        own = ["gid", "n", "at", "component", "band", *bits]
        left = member.select(F.col("token").alias("l_token"), F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int").alias("l_block"), *(F.col(c).alias(f"l_{c}") for c in own))
        right = member.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = right.select(F.col("token").alias("r_token"), "r_block", *(F.col(c).alias(f"r_{c}") for c in own))

        def lacks(x: str, y: str) -> Column:
            parts = [F.bit_count(F.col(f"{x}_{b}").bitwiseAND(F.bitwise_not(f"{y}_{b}"))) for b in bits]
            return sum(parts[1:], parts[0])

        bound = F.least(F.col("l_n") - lacks("l", "r"), F.col("r_n") - lacks("r", "l"))
        meet = (
            (F.col("l_token") == F.col("r_token")) & (F.col("l_block") == F.col("r_block"))
            & (F.col("l_component") != F.col("r_component"))
            & ((F.col("l_band") + 1 == F.col("r_band")) | (F.col("l_band") == F.col("r_band")) & (F.col("l_gid") < F.col("r_gid")))
            & _close(F.col("l_n"), F.col("r_n"), self.percent)
            & _reach(F.col("l_n"), F.col("l_at"), F.col("r_n"), F.col("r_at"), self.percent)
            & ((100 + self.percent) * bound >= self.percent * (F.col("l_n") + F.col("r_n")))
        )
        return left.join(right.hint("merge"), meet).select(F.greatest("l_gid", "r_gid").alias("a"), F.least("l_gid", "r_gid").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs; component_id is the smallest id reachable by
    links of Jaccard >= percent / 100 between the sets of distinct k-word shingles."""
    j = _Join(docs, id_col, text_col, k, percent)

    # 3. contraction with leaders
    pairs = C.materialize(j.possible(j.led()))
    first = C.materialize(C.connected_components(j.verified(pairs)))

    # 4. and 5. tiles of what is still apart
    label = first.select(F.col("id").alias("gid"), "component")
    apart = j.shared.join(label, "gid", "left").select("token", "gid", "n", "at", F.coalesce("component", "gid").alias("component"))
    late = j.verified(j.possible(j.tiled(apart)).join(pairs, ["a", "b"], "left_anti"))

    # 6. components and the smallest id of each
    links = first.select(F.col("id").alias("src"), F.col("component").alias("dst")).where("src <> dst").unionAll(late)
    final = C.connected_components(links).select(F.col("id").alias("gid"), "component")
    named = j.classes.join(final, "gid", "left").select("gid", "first_id", "copies", F.coalesce("component", "gid").alias("component"), F.col("component").isNotNull().alias("linked"))
    least = named.where("linked").groupBy("component").agg(F.min("first_id").alias("least"))
    known = named.where("linked or copies > 1").join(least, "component", "left").select("gid", F.coalesce("least", "first_id").alias("component_id"))
    out = j.rows.join(known, "gid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(class_a, class_b), every link between different sets, class_a below class_b; and (doc_id, class_id) of each row that has a
    set. Equal sets are one class, so copies aren't expanded; what is returned grows with the links of a group of near copies."""
    j = _Join(docs, id_col, text_col, k, percent)
    links = j.verified(j.possible(j.tiled(j.shared.withColumn("component", F.col("gid")))))
    members = j.rows.where("gid is not null").select("doc_id", F.col("gid").alias("class_id"))
    return links.select(F.least("src", "dst").alias("class_a"), F.greatest("src", "dst").alias("class_b")), members


def _reach(n: Column, at: Column, m: Column, to: Column, percent: int) -> Column:
    """Whether two sets whose first common shingle stands at these places of their orders can still overlap enough. Where it
    isn't their first common one the test may fail; the pair then passes it in the tile of the first."""
    return (100 + percent) * F.least(n - at, m - to) >= percent * (n + m)
