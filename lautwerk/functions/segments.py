"""Units as structures: their features, kinds, descriptions and wire format."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import inventory as I
from . import algebra as A
from . import text as X

FORM_SCHEMA = "type string, v int, spelling string, units array<string>, intervals array<struct<tier:string,start:int,end:int>>"

#: Order in which a description names features, and how values are worded.
_ORDER = ("airstream", "voiced", "nasalized", "labialized", "palatalized", "velarized", "pharyngealized", "retroflex", "rounded", "height", "backness", "place", "channel", "manner")
_WORDS = {("voiced", "+"): "voiced", ("voiced", "-"): "voiceless", ("airstream", "pulmonic"): "", ("channel", "flat"): "", ("channel", "grooved"): "sibilant", ("rounded", "+"): "rounded", ("rounded", "-"): ""}


def describe(unit: str) -> str:
    """An English phrase for a unit; empty if it can't be read."""
    bundle = I.bundle_of(unit) or {}
    out = []
    for f in _ORDER:
        v = bundle.get(f)
        if v is None or (v == "-" and f != "voiced"):
            continue
        if f == "voiced" and bundle.get("manner") == "vowel":
            continue
        word = _WORDS.get((f, v), f if v == "+" else v)
        if word:
            out.append(word)
    return " ".join(out)


def features_of(unit: Column) -> Column:
    """The flat bundle of a written unit, of several parts or one, with what its prosody states; null if it can't be read."""
    return A.let(A.structure(unit), lambda s: F.when(s.isNotNull(), A.overlay(A.scalar(s), A.prosody_of(s))))


def with_features(df: DataFrame, unit_col: str) -> DataFrame:
    """df with features (map) of a column of units."""
    return df.select("*", features_of(F.col(unit_col)).alias("features"))


def kind(unit: Column) -> Column:
    """Ten-way class of a unit by what its parts are: atomic, affricate, prenasalized, pre-stopped, lateral-release, click-accompaniment,
    double-articulation, overlay, diphthong or chain; null if it can't be read."""
    return A.let(A.structure(unit), lambda s: A.let(A.bundles(s, False), lambda b: A.classify(b, s["junctures"])))


def form_to_json(form: Column, intervals: Column | None = None) -> Column:
    """Versioned wire text of a form: type, v, spelling, units, intervals."""
    own = intervals if intervals is not None else F.array().cast("array<struct<tier:string,start:int,end:int>>")
    return A.let(form, lambda f: F.when(f.isNotNull(), F.to_json(F.struct(F.lit("form").alias("type"), F.lit(2).alias("v"), f.alias("spelling"), X.units(f).alias("units"), own.alias("intervals")))))


def form_from_json(wire: Column) -> Column:
    """The form of a wire text; null for another type or version, or what isn't JSON."""
    # named, as the optimizer would read the text anew for each field that is asked for
    return A.let(F.from_json(wire, FORM_SCHEMA), lambda x: F.when((x["type"] == "form") & (x["v"] == 2), x))


def canonical_json(value) -> str:
    """Sorted keys, no spaces, UTF-8, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def identity_fingerprint(value) -> str:
    return sha256(canonical_json(value).encode()).hexdigest()


# -- spellings of other kinds -----------------------------------------------------------------------------------------

_TONES = "̄́̌̀"


def pinyin(syllable: Column, tone: Column) -> Column:
    """Pinyin with its tone mark: on a or e, else on the o of ou, else on the last vowel; tone 5 or null has none."""
    mark = F.try_element_at(F.array(*(F.lit(t) for t in _TONES)), tone.cast("int"))
    s = F.replace(syllable, F.lit("v"), F.lit("ü"))
    at = F.when(s.rlike("[ae]"), F.regexp_replace(s, "^([^ae]*[ae])", "$1\u0001")).when(s.contains("ou"), F.replace(s, F.lit("ou"), F.lit("o\u0001u"))).otherwise(F.regexp_replace(s, "([iouü])(?=[^iouü]*$)", "$1\u0001"))
    return F.when(tone.between(1, 4), F.replace(at, F.lit("\u0001"), mark)).otherwise(s)


def katakana(mora: Column) -> Column:
    """Katakana of a romanized mora (consonant and vowel, n, or a vowel alone), from the regular layout of the block; null if it has none."""
    rows = {"": 0x30A2, "k": 0x30AB, "g": 0x30AC, "s": 0x30B5, "z": 0x30B6, "n": 0x30CA, "m": 0x30DE, "r": 0x30E9}
    steps = {"": 2, "k": 2, "g": 2, "s": 2, "z": 2, "n": 1, "m": 1, "r": 1}
    table = {c + v: chr(rows[c] + steps[c] * k) for c in rows for k, v in enumerate("aiueo")}
    table |= {c + v: chr(0x30CF + 3 * k + d) for d, c in enumerate("hbp") for k, v in enumerate("aiueo")}
    table |= {"ta": "タ", "ti": "チ", "tu": "ツ", "te": "テ", "to": "ト", "da": "ダ", "de": "デ", "do": "ド", "ya": "ヤ", "yu": "ユ", "yo": "ヨ", "wa": "ワ", "n": "ン"}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), mora)


def pinyin_input(written: Column) -> Column:
    """(syllable, tone) of a syllable with its tone number behind it; tone 5 where none is written, null if it isn't one."""
    good = written.rlike("^[a-zü:]+[1-5]?$")
    tone = F.coalesce(F.regexp_extract(written, "([1-5])$", 1).try_cast("int"), F.lit(5))
    return F.when(good, F.struct(F.replace(F.regexp_replace(written, "[1-5]$", ""), F.lit("u:"), F.lit("ü")).alias("syllable"), tone.alias("tone")))


def tone_index(syllable: Column) -> Column:
    """Where pinyin puts the tone mark: a or e, else the o of ou, else the last vowel; counted from 0, null without a vowel."""
    s = F.replace(syllable, F.lit("v"), F.lit("ü"))
    at = lambda p: F.length(F.regexp_extract(s, p, 1))
    return F.when(s.rlike("[ae]"), at("^([^ae]*)[ae]")).when(s.contains("ou"), at("^(.*?)ou")).when(s.rlike("[iouü]"), at("^(.*)[iouü][^iouü]*$"))


def katakana_word(morae: Column) -> Column:
    """(text, refused) of an array of romanized morae."""
    return F.struct(F.array_join(F.transform(F.filter(morae, lambda m: katakana(m).isNotNull()), katakana), "").alias("text"), F.filter(morae, lambda m: katakana(m).isNull()).alias("refused"))
