"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a text. The votes of all texts are counted by pattern, which are
at most 3 ** len(RULES) rows however many texts there are. Expectation-maximisation over these counts estimates how
often each rule votes for either class, given that it votes; the posterior of a pattern is then a column expression.
A text is kept when its posterior probability of being good reaches MIN_POSTERIOR, unless the base rules fail it.

Defined cases: a null text has no words and fails the base rules, as does an empty one; rows are independent, so
repeated rows get equal results and null ids pass through; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, words_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MIN_POSTERIOR = 0.5
ROUNDS = 50
#: What is believed before looking: a rule says bad of few good texts and of many bad ones. Each belief weighs as much
#: as BELIEF of the texts of its class, at every size; it keeps the classes from changing places.
BAD_GIVEN = {1: 0.02, 0: 0.4}
PRIOR_GOOD = 0.9
BELIEF = 0.3

#: name: (good if, bad if) over the measures of a text; otherwise the rule abstains. Percentages are of n_words.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("100 * n_symbols <= 5 * n_words", "100 * n_symbols >= 40 * n_words"),
    "symbol_share": ("100 * n_symbols <= word_chars", "100 * n_symbols >= 6 * word_chars"),
    "letters": ("100 * n_letters >= 93 * word_chars", "100 * n_letters <= 88 * word_chars"),
    "repeated_windows": ("100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words >= 25 * n_words"),
    "duplicate_lines": ("n_dup_lines = 0", "2 * n_dup_lines >= n_lines and n_dup_lines >= 2"),
    "word_length": ("word_chars between 2 * n_words and 12 * n_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    "capitals": ("100 * n_upper <= 15 * word_chars", "100 * n_upper >= 40 * word_chars"),
    "variety": ("100 * n_distinct >= 30 * n_words", "100 * n_distinct <= 10 * n_words"),
}


def _with_window_hashes(df: DataFrame) -> DataFrame:
    """Column wh: hash of every window of WINDOW hashes of h1, by doubling. A step a projection, so that none is computed twice."""
    df, step = df.withColumn("wh", F.col("h1")), 1
    while step < WINDOW:
        n = F.greatest(F.size("wh") - step, F.lit(0))
        df = df.withColumn("wh", F.zip_with(F.slice("wh", 1, n), F.slice("wh", step + 1, n), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    return df.drop("h1")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules use, all of whole texts."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    df = df.select("doc_id", "text", words_of(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_PATTERN)).alias("lines"))
    df = df.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h1"), F.array_join("w", "").alias("joined"))
    df = df.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        (F.length("joined") - F.length(F.regexp_replace("joined", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("joined") - F.length(F.regexp_replace("joined", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length("joined") - F.length(F.regexp_replace("joined", r"[^\p{L}]+", ""))).cast("long").alias("n_not_letters"),
        F.size(F.array_distinct("h1")).cast("long").alias("n_distinct"),
        "h1",
    )
    df = df.select("*", (F.col("word_chars") - F.col("n_not_letters")).alias("n_letters")).drop("n_not_letters")
    df = _with_window_hashes(df)
    # positions of the windows that have an equal one, in order; each covers what the next one leaves to it
    seen = F.size("wh") > F.size(F.array_distinct("wh"))
    tagged = F.sort_array(F.transform("wh", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.select("*", F.when(seen, tagged).alias("tagged")).drop("wh")
    near = lambda t, i: t["h"] == F.try_element_at("tagged", i)["h"]  # noqa: E731  i counts from 1
    twins = F.filter("tagged", lambda t, i: F.coalesce(F.when(i > 0, near(t, F.when(i > 0, i).otherwise(1))), F.lit(False)) | F.coalesce(near(t, i + 2), F.lit(False)))
    df = df.select("*", F.sort_array(F.transform(twins, lambda t: t["i"])).alias("at")).drop("tagged")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last")),
        lambda a: a["sum"],
    )
    return df.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("at")


def _estimate(counts: dict[tuple[int, ...], int]) -> tuple[float, list[dict[tuple[int, int], float]]]:
    """Prior of good, and for each rule P(vote | class, not abstaining) under (vote, class); class 1 good, 0 bad."""
    total = sum(counts.values()) or 1
    start = {1: BELIEF * PRIOR_GOOD * total, 0: BELIEF * (1 - PRIOR_GOOD) * total}
    prior = PRIOR_GOOD
    acc = [{(v, c): b if v < 0 else 1 - b for c, b in BAD_GIVEN.items() for v in (1, -1)} for _ in RULES]
    for _ in range(ROUNDS):
        mass, votes_of = dict(start), [{(v, c): a * start[c] for c, b in BAD_GIVEN.items() for v, a in ((-1, b), (1, 1 - b))} for _ in RULES]
        for votes, n in sorted(counts.items()):
            p = _posterior(votes, prior, acc)
            for c, share in ((1, n * p), (0, n * (1 - p))):
                mass[c] += share
                for seen, v in zip(votes_of, votes, strict=True):
                    if v:
                        seen[v, c] += share
        prior = mass[1] / (mass[1] + mass[0])
        acc = [{(v, c): seen[v, c] / (seen[1, c] + seen[-1, c]) for v, c in seen} for seen in votes_of]
    return prior, acc


def _posterior(votes: tuple[int, ...], prior: float, acc: list[dict[tuple[int, int], float]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(a[v, 1] / a[v, 0]) for v, a in zip(votes, acc, strict=True) if v)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed, posterior (good) and kept, a row for each row of docs."""
    m = materialize(measures(docs, id_col, text_col))
    vote = {name: F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for name, (good, bad) in RULES.items()}
    votes = m.select("*", *(v.cast("int").alias(f"vote_{k}") for k, v in vote.items()))
    names = [f"vote_{k}" for k in RULES]
    patterns = votes.where("n_words > 0").groupBy(*names).count().limit(3 ** len(RULES)).collect()
    prior, acc = _estimate({tuple(r[n] for n in names): r["count"] for r in patterns})
    odds = F.lit(math.log(prior / (1 - prior)))
    for n, a in zip(names, acc, strict=True):
        odds = odds + F.when(F.col(n) > 0, math.log(a[1, 1] / a[1, 0])).when(F.col(n) < 0, math.log(a[-1, 1] / a[-1, 0])).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = votes.select("*", failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("posterior"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= MIN_POSTERIOR)).alias("kept"), "posterior", *names)
