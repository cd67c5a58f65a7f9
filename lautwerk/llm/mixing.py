"""Mixing sources to target weights, in DataFrame functions only.

The words of each source stand one after another in a fixed order and are cut into blocks of BLOCK words. An output of
1.5 times all words consists of slots, SHARD of them to an output shard. Source k owns as many slots as its target has
blocks; a keyed pseudorandom permutation of all slots says which these are. The source counts of a shard are thus
multinomial draws conditioned on the totals (draws without replacement), so that chance doesn't move a source off its
target. A slot's number among those of its source goes through a permutation keyed by the source, which gives the block
that it takes: a source goes through all its blocks before it repeats one. Slots are made from the table of sources, two
explodes deep, so nothing is joined or broadcast for that; blocks and texts are joined by (source, block).

No step holds a source, or all sources, in one task: word offsets, the numbering of sources and the numbering of their
slots are running sums over ranges of rows, which are as many as there are shuffle partitions. Targets come from a few
sums over the table of sources. Rows that agree in everything but their place are told apart by that place, so a group
of them can be cut between ranges.

Defined cases: null texts have size 0; null sources are one source, weighed last; rows with equal ids are separate rows
in the order of their texts' hashes; sources without words have target 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_of

BLOCK = 32
SHARD = 4096
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_TIMES = 2
SEED = 17
#: Of a permutation.
ROUNDS = 4


def permuted(df: DataFrame, i: Column, n: Column, key: Column, out: str) -> DataFrame:
    """df with out: where a keyed permutation of 0 .. n - 1 takes i, for n below 2 ** 62.

    The first a * b numbers (a about the root of n) are read as two digits and mixed: each round adds a hash of one digit to the
    other. The few above a * b stay, so all are rotated by a hash of the key before and after.
    """
    df = df.withColumns({"__n": n, "__key": key})
    turn = lambda k: F.pmod(F.xxhash64("__key", F.lit(k)), F.col("__n"))
    df = df.withColumns({"__x": F.pmod(i + turn(-1), F.col("__n")), "__a": F.greatest(F.floor(F.sqrt("__n")), F.lit(1)).cast("long")})
    df = df.withColumn("__b", F.expr("__n div __a")).withColumns({"__u": F.expr("__x div __b"), "__v": F.expr("__x % __b")})
    for k in range(ROUNDS):
        own, other, base = ("__u", "__v", "__a") if k % 2 else ("__v", "__u", "__b")
        df = df.withColumn(own, F.expr(f"pmod({own} + (xxhash64(__key, {k}, {other}) & {(1 << 62) - 1}), {base})"))
    mixed = F.when(F.col("__x") < F.col("__a") * F.col("__b"), F.col("__u") * F.col("__b") + F.col("__v")).otherwise(F.col("__x"))
    # never null, which keeps the optimizer from testing that below the chain of projections, with all of it written out at once
    return df.withColumn(out, F.coalesce(F.pmod(mixed + turn(-2), F.col("__n")), F.lit(0))).drop("__x", "__n", "__key", "__a", "__b", "__u", "__v")


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df, sorted into ranges of rows that column part numbers, written out."""
    return materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def _running(ranged: DataFrame, order: list[Column], value: Column, out: str, by: list[str]) -> DataFrame:
    """ranged with out: the sum of value over the rows before it (of the same by). No window sees more than a range."""
    parts = ranged.groupBy("part", *by).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("part") if by else Window.orderBy("part")
    parts = parts.select("part", *by, F.coalesce(F.sum("__sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    parts = parts.withColumnsRenamed({"part": "__part"} | {c: f"__{c}" for c in by})
    on = rows["part"] == parts["__part"]
    for c in by:
        on = on & rows[c].eqNullSafe(parts[f"__{c}"])
    return rows.join(parts, on).withColumn(out, (F.col("__before") + F.col("__inside")).cast("long")).drop("__before", "__inside", *parts.columns)


def plan_sources(sums: DataFrame) -> DataFrame:
    """A row for each source of (source, source_size): k, its target, blocks, slots and the number of its first slot."""
    by_name = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS) + 1).cast("int"))
    named = materialize(_running(_ranged(sums, *by_name), by_name, F.lit(1), "k", []).withColumn("weight", weight))
    # a source is full when its share by weight is more than it may give; what is left is shared again until none is
    most = MOST_TIMES * F.col("source_size")
    n, w = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    total, share, before = n * SHARE_PERCENT / 100, n * SHARE_PERCENT / 100 / w, 0
    while True:
        full = F.lit(share) * F.col("weight") > most
        r = named.where(full).agg(F.count("*").alias("n"), F.coalesce(F.sum(most), F.lit(0)).alias("given"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
        if r["n"] == before or r["weight"] == w:
            break
        before, share = r["n"], (total - r["given"]) / (w - r["weight"])
    target = F.when(full, most.cast("double")).otherwise(F.lit(share) * F.col("weight"))
    blocks = F.ceil(F.col("source_size") / BLOCK)
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    out = named.withColumn("target", target).withColumn("blocks", blocks).withColumn("slots", slots)
    return materialize(_running(out, by_name, F.col("slots"), "first_slot", []).drop("part", "weight"))


def filled_slots(sources: DataFrame) -> DataFrame:
    """(shard, slot, source, k, block): what fills each slot of the output."""
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    # runs of SHARD * SHARD slots, then of SHARD, dealt out anew, then slots: no array is longer than SHARD or a source's runs
    runs = sources.where("slots > 0").select("source", "k", "blocks", "slots", "first_slot", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {SHARD * SHARD}"))).alias("run"))
    last = F.least(F.expr(f"(slots - 1) div {SHARD}"), (F.col("run") + 1) * SHARD - 1)
    # by number: these rows are few bytes for the work that they stand for, so sizes would put them into one task
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.withColumn("run", F.explode(F.sequence(F.col("run") * SHARD, last))).repartition(tasks, "k", "run")
    at = F.sequence(F.col("run") * SHARD, F.least(F.col("slots"), (F.col("run") + 1) * SHARD) - 1)
    made = runs.select("source", "k", "blocks", (F.col("first_slot")).alias("first_slot"), F.explode(at).alias("ordinal"))
    made = permuted(made, F.col("first_slot") + F.col("ordinal"), F.lit(max(total, 1)).cast("long"), F.lit(SEED), "slot")
    made = permuted(made, F.col("ordinal") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(SEED), "k"), "block")
    return made.select(F.expr(f"slot div {SHARD}").alias("shard"), "slot", "source", "k", "block")


class Mix:
    """Where the words of each row stand within their source, and the plan of the sources."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, keep_words: bool = False):
        words = words_of(F.col(text_col))
        df = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words).cast("long").alias("size"), F.xxhash64(text_col).alias("text_hash"), *([words.alias("words")] if keep_words else []))
        rows = materialize(df.withColumn("row", F.monotonically_increasing_id()))
        self.sources = plan_sources(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
        order = [F.col("source"), F.col("doc_id"), F.col("text_hash"), F.col("row")]
        placed = _running(_ranged(rows.drop("words"), *order), order[1:], F.col("size"), "start", ["source"])
        own = self.sources.select(F.col("source").alias("__source"), "k", "source_size", "target")
        self.placed = materialize(placed.join(own, placed["source"].eqNullSafe(own["__source"])).drop("__source", "text_hash", "part"))
        self.words = rows.select("row", "words") if keep_words else None

    def pieces(self) -> DataFrame:
        """(row, k, block, start, size): a row for each block that a text has a part in."""
        first, last = F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")
        return self.placed.where("size > 0").select("row", "k", "start", "size", F.explode(F.sequence(first, last)).alias("block"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, first_shard), a row for each row of docs; first_shard is the first
    output shard that holds some of it, null if none does."""
    mix = Mix(docs, id_col, text_col, source_col)
    taken = filled_slots(mix.sources).groupBy("k", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    overlap = F.least((F.col("block") + 1) * BLOCK, F.col("start") + F.col("size")) - F.greatest(F.col("block") * BLOCK, F.col("start"))
    # the slots are made from a few rows, so their number isn't in the estimates that a join is chosen by
    per_row = mix.pieces().join(taken.hint("merge"), ["k", "block"]).select("row", (overlap * F.col("times")).alias("words"), "shard").groupBy("row").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    out = mix.placed.join(per_row, "row", "left")
    return out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mixed_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(shard, slot, source, block): the mixed output, a row for each slot; block counts from 0 within its source."""
    return filled_slots(Mix(docs, id_col, text_col, source_col).sources).drop("k")


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(shard, slot, source, block, text): the mixed output with its words, joined by a space."""
    mix = Mix(docs, id_col, text_col, source_col, keep_words=True)
    lo = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0)).cast("int")
    hi = F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size")).cast("int")
    parts = mix.pieces().join(mix.words, "row").select("k", "block", F.struct("start", F.slice("words", lo + 1, hi - lo).alias("words")).alias("part"))
    # a block has at most BLOCK words, so at most as many parts
    blocks = parts.groupBy("k", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    text = F.array_join(F.flatten(F.transform("parts", lambda p: p["words"])), " ")
    return filled_slots(mix.sources).join(blocks.select("k", "block", text.alias("text")).hint("merge"), ["k", "block"]).select("shard", "slot", "source", "block", "text")


def shards(docs: DataFrame) -> DataFrame:
    """(shard, source, slots): how many blocks of each source an output shard holds."""
    return mixed_slots(docs).groupBy("shard", "source").agg(F.count("*").alias("slots"))
