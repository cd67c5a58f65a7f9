"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A mask marks which of some neighbouring words are hashed; the others may differ. Every position of every text is hashed under
MASK, which skips its third word, and joined with the hashes of the benchmark items. A hit fixes a diagonal (start of the item within the text);
along it the words of text and item are compared one by one, and the pair is reported when some stretch of STRETCH
aligned words (the whole item, if shorter) has at least LEAST_EQUAL percent equal words. A stretch that an end of the
text cuts short needs SPAN words, or the whole item.

The seeds miss no pair that this rule accepts: laid out over all patterns of equal and substituted words that it accepts
in stretches of 6, 7 and 9 to 13 words, MASK finds its three words equal somewhere in each. In 1 to 5 and 8 words some
patterns escape it, so items of exactly those lengths have other masks beside it. Items of fewer than ``shortest`` words
aren't evidence of anything and are left out; any value from 1 on is exact.

A run of equal words gives many hits on its diagonal; of those at one place after another only the first goes on, and only
the stretches around it are tried before anything is shuffled: one that holds a later hit can be moved left to the first,
as all words on the way are equal. Seeds and items are broadcast while they are estimated at BROADCAST_BYTES at most.
Beyond that, places (a text's id and hash, position, seed) are joined by shuffle, and the words of a text are fetched only
where a seed was hit; no words are in that shuffle.

Spark holds all hits of a row until the last of its positions is done, so a hit must not carry the text: it takes the words
along its diagonal only. A text of more than WHOLE_BYTES isn't held as one array of words either: it is cut into units of as
many words as the longest item has (UNIT at least), and a piece takes some units as its own (CORE words or more) and one on
either side, in which every diagonal through its own places lies whole. Places are found once, each by the piece that owns it,
and counted from the start of the text.

Items of the same words are matched once, and the pairs that were found are then given to each of them, so a benchmark that
repeats itself takes no more seeds.

Defined cases: null or empty texts and items match nothing; repeated items and texts are reported row by row but once
for each (doc_id, item_id); null ids pass through; empty tables give empty results; letters A-Z count as a-z; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, WORD_PATTERN, ascii_lower, materialize, words_of

#: 1: hashed, 0: ignored.
MASK = "1101"
#: For items of exactly so many words, beside MASK.
GAPPED = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("111", "1011"), 5: ("10101",), 8: ("10011",)}
SPAN = 10
SHORTEST = 5
STRETCH = 13
LEAST_EQUAL = 75
BROADCAST_BYTES = 64 << 20
#: What a broadcast seed takes, about: some numbers, two words and their place in the hash table.
SEED_BYTES = 128
#: Longer texts are cut.
WHOLE_BYTES = 16 << 10
UNIT = 64
CORE = 2048
#: No text has so many words.
NO_END = (1 << 31) - 1


def _seed(words: str, at: Column, mask: str) -> Column:
    """Hash of the words under the mask at a position that counts from 0."""
    return F.xxhash64(F.lit(mask), *(F.get(F.col(words), at + k) for k, m in enumerate(mask) if m == "1"))


def _pieces(docs: DataFrame, id_col: str, text_col: str, longest: int, whole_bytes: int) -> DataFrame:
    """(doc_id, before, first, end, w): the words of the texts, of long ones piece by piece. before: words of the text before the
    piece; places from first up to end are its own, the others its neighbours'. longest: words of the longest item."""
    unit = max(longest, UNIT)
    core = -(-CORE // unit)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # possessive, so nothing is tried twice or by recursion; spaces go with the word before, so units side by side are the text
    cut = F.regexp_extract_all(text, F.lit(f"(?:{WORD_PATTERN}+{SPACE_PATTERN[:-1]}*+){{1,{unit}}}+"), F.lit(0))
    units = docs.select(F.col(id_col).alias("doc_id"), F.when(F.octet_length(text) <= whole_bytes, F.array(text)).otherwise(cut).alias("units"))
    n = F.size("units")

    def piece(at: Column) -> Column:
        lo = F.greatest(at - 1, F.lit(0))
        end = F.when(at + core >= n, F.lit(NO_END)).otherwise((at - lo + core) * unit)
        words = F.array_join(F.slice("units", lo + 1, at - lo + core + 1), "")
        return F.struct((lo * unit).alias("before"), ((at - lo) * unit).alias("first"), end.alias("end"), words.alias("piece"))

    pieces = units.select("doc_id", F.inline(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(core)), piece))))
    return pieces.select("doc_id", "before", "first", "end", words_of(ascii_lower(F.col("piece"))).alias("w"))


def _seeds(df: DataFrame, words: str, masks: list[str]) -> DataFrame:
    """A row for each position and mask that fits there, with the seed, the position and the width of the mask."""
    n = F.size(words)
    last = F.greatest(n - min(map(len, masks)), F.lit(-1))
    at = df.withColumn("at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
    if len(masks) == 1:
        return at.withColumn("seed", _seed(words, F.col("at"), masks[0]))
    return at.withColumn("seed", F.explode(F.array(*(F.when(F.col("at") + len(m) <= n, _seed(words, F.col("at"), m)) for m in masks))))


def _promising(near_at: Column, item_at: Column) -> Column:
    """Whether two of the five words before a seed (near_at in the part) are equal, or two of the five after it. A stretch of SPAN
    words or more that is accepted and holds the seed has six more outside of it at least, of which two may differ, or eight, of
    which three may: on one side there are three equal ones, or two among the nearest five where all stand on one side."""
    same = lambda k: F.coalesce(F.get("part", near_at + k) == F.get("item", item_at + k), F.lit(False)).cast("int")
    n = len(MASK)
    return (sum((same(k) for k in range(n + 1, n + 5)), same(n)) >= 2) | (sum((same(-k) for k in range(2, 6)), same(-1)) >= 2)


def _part(n_item: Column) -> Column:
    """The words of the text along the diagonal (w, start)."""
    return F.slice("w", F.greatest("start", F.lit(0)) + 1, n_item - F.greatest(-F.col("start"), F.lit(0)))


def _diagonal(hits: DataFrame, *keep: str) -> DataFrame:
    """hits (part, item, start, and the columns to keep) with the aligned part of the item, too."""
    return hits.select(*keep, "start", "part", F.slice("item", F.greatest(-F.col("start"), F.lit(0)) + 1, F.size("item")).alias("item_part"), F.size("item").alias("n_item"))


def _accepted(hits: DataFrame, *keep: str, near: str | None = None) -> DataFrame:
    """Of diagonals (part, item_part, start, n_item) those that the rule accepts, as equal (0 or 1 for each place). near: place of
    the part's first word that the text has at a seed; stretches that don't hold it aren't tried."""
    both = F.least(F.size("part"), F.size("item_part"))
    m = F.least(F.lit(STRETCH), both)
    if near:
        lo = F.greatest(F.col(near) - m + 1, F.lit(0))
        hits = hits.select("*", m.alias("m"), both.alias("both"), lo.alias("lo"), F.least(both - lo, F.col(near) + m - lo).alias("span"))
        window = F.zip_with(F.slice("part", F.col("lo") + 1, F.col("span")), F.slice("item_part", F.col("lo") + 1, F.col("span")), lambda a, b: (a == b).cast("int"))
    else:
        hits = hits.select("*", m.alias("m"), both.alias("both"))
        window = F.zip_with(F.slice("part", F.lit(1), both), F.slice("item_part", F.lit(1), both), lambda a, b: (a == b).cast("int"))
    hits = hits.where("m > 0").where(F.col("m") >= F.least(F.lit(SPAN), F.col("n_item"))).withColumn("near", window)
    # equal words of a stretch: those up to its end, less those before it
    runs = F.aggregate("near", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    hits = hits.withColumn("sums", runs)
    enough = F.exists(F.sequence(F.lit(0), F.size("near") - F.col("m")), lambda i: 100 * (F.get("sums", i + F.col("m")) - F.get("sums", i)) >= LEAST_EQUAL * F.col("m"))
    return hits.where(enough).select(*keep, "start", F.zip_with(F.slice("part", F.lit(1), F.col("both")), F.slice("item_part", F.lit(1), F.col("both")), lambda a, b: (a == b).cast("int")).alias("equal"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shortest: int = SHORTEST, broadcast_bytes: int = BROADCAST_BYTES, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(doc_id, item_id, n_equal, n_aligned, first_word): the pairs that overlap, with the best stretch."""
    named = items.select(F.col(item_col).alias("item_id"), words_of(ascii_lower(F.coalesce(F.col(item_text_col), F.lit("")))).alias("item"))
    named = materialize(named.where(F.size("item") >= max(shortest, 1)).distinct())
    # items of the same words are one until their pairs are found
    bench = materialize(named.select("item").distinct().withColumn("key", F.monotonically_increasing_id()))
    size = bench.agg(F.coalesce(F.sum(F.size("item")), F.lit(0)), F.coalesce(F.sum(F.length(F.array_join("item", " "))), F.lit(0)), F.coalesce(F.max(F.size("item")), F.lit(0))).first()
    lengths = sorted(r[0] for r in bench.select(F.size("item").alias("n")).where(F.col("n").isin(list(GAPPED))).distinct().limit(len(GAPPED)).collect())
    extra = [(n, mask) for n in lengths for mask in GAPPED[n]]
    seeds = _seeds(bench, "item", [MASK])
    for n, mask in extra:
        seeds = seeds.unionAll(_seeds(bench.where(F.size("item") == n), "item", [mask]))
    at, item_at = F.col("at"), F.col("item_at")
    # MASK hits one place earlier, too, if the words there that this hit doesn't show are equal
    shown = {k + 1 for k, m in enumerate(MASK) if m == "1"}
    hidden = [k - 1 for k, m in enumerate(MASK) if m == "1" and k not in shown]
    beside = [F.get("item", at + k).alias(f"item_word{n}") for n, k in enumerate(hidden)]
    seeds = seeds.select("seed", "key", at.alias("item_at"), F.size("item").alias("n_item"), *beside)
    masks = [MASK, *(mask for _, mask in extra)]

    texts = _pieces(docs, id_col, text_col, size[2], whole_bytes)
    own = (at >= F.col("first")) & (at < F.col("end"))
    if SEED_BYTES * size[0] + size[1] <= broadcast_bytes:
        hits = _seeds(texts, "w", masks).where(own).join(F.broadcast(seeds), "seed")
        # hits of other masks stay
        alike = [F.get("w", at + k) == F.col(f"item_word{n}") for n, k in enumerate(hidden)]
        later = (at > 0) & (item_at > 0) & (F.col("n_item") >= SPAN) & reduce(lambda a, b: a & b, alike)
        hits = hits.where(~later).withColumn("start", at - item_at)
        hits = hits.select("doc_id", "before", "key", "start", "item_at", F.least(at, item_at).alias("near_at"), _part(F.col("n_item")).alias("part")).join(F.broadcast(bench), "key")
        hits = hits.where((F.size("item") < SPAN) | _promising(F.col("near_at"), item_at))
        hits = _accepted(_diagonal(hits, "doc_id", "before", "key", "near_at"), "doc_id", "before", "key", near="near_at")
    else:
        texts = texts.withColumn("hash", F.xxhash64("w"))
        places = _seeds(texts, "w", masks).where(own).select("doc_id", "before", "hash", "at", "seed")
        found = places.join(seeds.hint("merge"), "seed").select("doc_id", "before", "hash", "key", (at - item_at).alias("start")).distinct()
        found = materialize(found.join(bench, "key").withColumnsRenamed({"doc_id": "d", "before": "b", "hash": "h"}))
        once = texts.select("doc_id", "before", "w", "hash").dropDuplicates(["doc_id", "before", "hash"])
        hits = found.join(once, found["d"].eqNullSafe(once["doc_id"]) & (found["b"] == once["before"]) & (found["h"] == once["hash"]))
        hits = _accepted(_diagonal(hits.withColumn("part", _part(F.size("item"))), "doc_id", "before", "key"), "doc_id", "before", "key")
    hits = hits.withColumn("start", F.col("start") + F.col("before"))
    total = F.aggregate("equal", F.lit(0), lambda a, x: a + x)
    best = F.max_by(F.struct(total.alias("n_equal"), F.size("equal").alias("n_aligned"), "start"), F.struct(total, -F.col("start")))
    ids = named.join(bench, "item").select("key", "item_id")
    ids = F.broadcast(ids) if SEED_BYTES * named.count() <= broadcast_bytes else ids
    found = hits.groupBy("doc_id", "key").agg(best.alias("b")).join(ids, "key")
    out = found.groupBy("doc_id", "item_id").agg(F.max_by("b", F.struct("b.n_equal", -F.col("b.start"))).alias("b"))
    return out.select("doc_id", "item_id", "b.n_equal", "b.n_aligned", F.greatest("b.start", F.lit(0)).alias("first_word"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that overlap with no item; of a doc_id that does, every row goes."""
    dirty = decontaminate(docs, items).select(F.col("doc_id").alias("dirty_id")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["dirty_id"]), "left_anti")
