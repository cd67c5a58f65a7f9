"""Intervals over units: syllables, morae, timed alignment, and how two analyses differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import inventory as I
from ..functions import text as X
from ..plans.terms import parse, symbols

#: Onsets of two consonants, as feature terms of each; one consonant always is one.
LANGUAGES = {"spanish": [("obstruent", "manner=tap"), ("obstruent", "manner=trill"), ("obstruent", "channel=lateral")], "open": []}


def _class(terms: str) -> str:
    return "[" + "".join(X.compounds().get(s, s) for s in symbols(parse(terms))) + "]"


def syllabify(form: Column, language: str | list[tuple[str, str]] = "spanish") -> Column:
    """Syllables of a form: nuclei are vowels, each takes the longest licensed onset before it, the rest is coda. A language is one of
    LANGUAGES, or its onsets of two consonants, as feature terms of each.

    One pass of a regular expression: a break goes where a licensed onset with its vowel begins after an earlier vowel.
    """
    vowel = _class("vowel")
    onsets = [f"{_class(a)}{X.AFTER_CLASS}*{_class(b)}" for a, b in (LANGUAGES[language] if isinstance(language, str) else language)]
    consonant = f"(?!{vowel}){X.base_class()}{X.AFTER_CLASS}*"
    # written breaks are derived anew
    e = F.regexp_replace(X.encode(form), r"\.", "")
    two = "|".join(onsets) or "(?!)"
    nucleus = f"{X.STRESS_CLASS}{{0,2}}{vowel}"
    v = f"({vowel}{X.AFTER_CLASS}*)"
    hiatus = F.regexp_replace(e, f"{v}(?={nucleus})", "$1.")
    marked = F.regexp_replace(hiatus, f"(?<=[^.#\\s])((?:{two}){X.AFTER_CLASS}*|{consonant})(?={nucleus})", ".$1")
    # a break before the form's or a word's first vowel would cut off its onset
    first = F.regexp_replace(marked, f"(^|[#\\s])((?:(?!{vowel})[^.#\\s])*)\\.", "$1$2")
    return F.filter(F.split(X.decode(first), r"[.#\s]"), lambda s: s != "")


def syllable_marks(form: Column, language: str | list[tuple[str, str]] = "spanish") -> Column:
    """Places (units before) of the breaks that syllabify derives."""
    return F.transform(F.filter(as_intervals(syllabify(form, language), "syllable"), lambda i: i["start"] > 0), lambda i: i["start"].cast("long"))


def syllable_conflicts(form: Column, language: str | list[tuple[str, str]] = "spanish") -> Column:
    """(at, side) of the breaks that are only written or only derived; word boundaries count as both."""
    written = F.transform(X.boundaries(form), lambda b: b["at"])
    derived = syllable_marks(form, language)
    of = lambda a, side: F.transform(a, lambda at: F.struct(at.alias("at"), F.lit(side).alias("side")))
    return F.array_sort(F.concat(of(F.array_except(written, derived), "written"), of(F.array_except(derived, written), "derived")))


def morae(form: Column) -> Column:
    """(parts, rest) by the Japanese analysis: a vowel with at most a consonant and a palatal approximant before it, a nasal alone, or
    a long consonant; rest holds what is none of these. Written boundaries are left out."""
    vowel, nasal, glide, after = _class("vowel"), _class("nasal"), _class("manner=approximant palatal"), X.AFTER_CLASS
    consonant = f"(?!{vowel}){X.base_class()}{after}*"
    mora = f"(?:{consonant})?(?:{glide}{after}*)?{X.STRESS_CLASS}?{vowel}{after}*|{nasal}{after}*|{consonant[:-1]}*?ː"
    e = F.regexp_replace(X.encode(form), f"{X.BOUNDARY_CLASS}|\\s", "")
    parts = F.transform(F.regexp_extract_all(e, F.lit(f"({mora})"), 1), X.decode)
    return F.struct(parts.alias("parts"), X.units(X.decode(F.regexp_replace(e, mora, "."))).alias("rest"))


def mora_count(form: Column) -> Column:
    """Morae: vowels, long ones twice, and consonants that close a syllable."""
    nasal = _class("nasal")
    vowel = _class("vowel")
    e = X.encode(form)
    count = lambda p: F.size(F.regexp_extract_all(e, F.lit(f"({p})"), 1))
    return (count(vowel) + count(f"{vowel}{X.AFTER_CLASS}*?ː") + count(f"{nasal}(?!{X.AFTER_CLASS}*{vowel})")).cast("long")


def as_intervals(parts: Column, tier: str) -> Column:
    """(tier, start, end) in units of consecutive parts of a form."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<tier:string,start:int,end:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a["n"] + F.size(X.units(p))
        return F.struct(end.alias("n"), F.array_append(a["out"], F.struct(F.lit(tier).alias("tier"), a["n"].alias("start"), end.alias("end"))).alias("out"))

    return F.aggregate(parts, start, step, lambda a: a["out"])


def interval_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (keys, tier, start, end) that one side has alone, with the side. keys may repeat rows on either side."""
    on = [*keys, "tier", "start", "end"]
    a = left.select(*on).distinct().withColumn("l", F.lit(1))
    b = right.select(*on).distinct().withColumn("r", F.lit(1))
    return a.join(b, on, "full").where("l is null or r is null").select(*on, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def rebase(start: Column, end: Column, edits: Column) -> Column:
    """An interval after edits (at, removed, added) in order of place; null where an end falls inside what an edit replaces."""

    def move(point: Column) -> Column:
        shift = F.aggregate(F.filter(edits, lambda e: e["at"] + e["removed"] <= point), F.lit(0), lambda a, e: a + e["added"] - e["removed"])
        return F.when(~F.exists(edits, lambda e: (e["at"] < point) & (point < e["at"] + e["removed"])), point + shift)

    a, b = move(start), move(end)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))


def timed_overlaps(df: DataFrame, key: str, start: str, duration: str, tie: str | None = None) -> DataFrame:
    """Rows that begin before some earlier row of the same key has ended; before_end is the latest end so far. Of rows that begin
    together the shorter comes first, then the smaller tie. The window is within a key."""
    order = [start, duration] + ([tie] if tie else [])
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before_end", F.max(F.col(start) + F.col(duration)).over(w)).where(F.col("before_end") > F.col(start))


def stress_class(form: Column) -> Column:
    """Number of the stressed unit among the vowels, from the end; null without stress."""
    vowels = F.filter(X.units(form), lambda u: X.encode(u).rlike(_class("vowel")))
    hits = F.filter(F.transform(vowels, lambda u, i: F.when(u.rlike(f"^{X.STRESS_CLASS}"), F.size(vowels) - i)), lambda x: x.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def vowels_of_inventory() -> list[str]:
    return [s for s, b in I.stated().items() if b["manner"] == "vowel"]


def read_forms(df: DataFrame, form_col: str) -> DataFrame:
    """df with units, boundaries (at, mark), prosody (at, glyph) and lost: what a reader of a form gets, in one projection."""
    form = F.col(form_col)
    return df.select("*", X.units(form).alias("units"), X.boundaries(form).alias("boundaries"), X.prosody(form).alias("prosody"), X.lost(form).alias("lost"))


def boundary_levels(form: Column) -> Column:
    """Level of each boundary, by the ladder syllable, word, phrase, utterance."""
    table = F.create_map(*(F.lit(x) for kv in I.BOUNDARIES.items() for x in kv))
    return F.transform(X.boundaries(form), lambda b: F.struct(b["at"].alias("at"), F.try_element_at(table, b["mark"]).alias("level")))


def spans_of_level(form: Column, level: str) -> Column:
    """(tier, start, end) of the stretches between boundaries at least as strong as the level; empty stretches are left out."""
    strong = "".join(m for m, name in I.BOUNDARIES.items() if I.LADDER.index(name) >= I.LADDER.index(level))
    parts = F.filter(F.split(form, f"[{strong}\\s]+"), lambda p: p != "")
    return as_intervals(parts, level)


def edges_on(form: Column, level: str) -> Column:
    """Starts of the stretches of a level; the edge of a form counts as every level."""
    return F.transform(spans_of_level(form, level), lambda i: i["start"])


def stress_signature(form: Column) -> Column:
    """One digit for each vowel: 1 primary, 2 secondary, 0 none."""
    vowels = F.filter(X.units(form), lambda u: X.encode(u).rlike(_class("vowel")))
    return F.array_join(F.transform(vowels, lambda u: F.when(u.contains("ˈ"), "1").when(u.contains("ˌ"), "2").otherwise("0")), "")


def apply_signature(form: Column, signature: Column) -> Column:
    """The form with its vowels stressed as the signature says; null when it has another number of vowels."""
    bare = F.regexp_replace(form, X.STRESS_CLASS, "")
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(a: Column, t: Column) -> Column:
        vowel = X.encode(t).rlike(_class("vowel"))
        digit = F.substring(signature, a["n"] + 1, F.lit(1))
        mark = F.when(vowel & (digit == "1"), "ˈ").when(vowel & (digit == "2"), "ˌ").otherwise("")
        return F.struct((a["n"] + F.when(vowel, 1).otherwise(0)).alias("n"), F.concat(a["out"], mark, t).alias("out"))

    done = F.aggregate(X.tokens(bare), start, step)
    return F.when(done["n"] == F.length(signature), done["out"])
