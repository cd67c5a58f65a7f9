"""Reading transcriptions: import of foreign spellings, tokens, losses, validity.

Everything but the Unicode canonicalization is a built-in string function and stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import inventory as I

_PLAIN: ContextVar[bool] = ContextVar("plain", default=False)


def is_plain() -> bool:
    return _PLAIN.get()


@contextmanager
def plain(on: bool = True):
    """While expressions are built (in this thread): forms have no diacritics, prosody or unregistered ties, so that each
    character of an encoded form is a token. Patterns are then several times as fast."""
    token = _PLAIN.set(on or is_plain())
    try:
        yield
    finally:
        _PLAIN.reset(token)


def free(df, name: str) -> str:
    """A name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@cache
def compounds() -> dict[str, str]:
    """Tied symbols of the inventory and the private character that stands for each while patterns run."""
    return {s: chr(0xE000 + k) for k, s in enumerate(x for x in I.phones() if len(x) > 1)}


def atoms() -> str:
    return "".join(s for s in I.phones() if len(s) == 1)


def ranges(chars: str) -> str:
    """What a character class of a regular expression holds, as ranges from the lowest up: it asks one after another for each character of a text."""
    quoted = lambda n: ("\\" if chr(n) in "\\[]^-&" else "") + chr(n)
    runs: list[list[int]] = []
    for n in sorted({ord(c) for c in chars}):
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return "".join(quoted(a) if a == b else f"{quoted(a)}-{quoted(b)}" for a, b in runs)


DIACRITIC_CLASS = "[" + ranges("".join(I.DIACRITICS)) + "]"
AFTER_CLASS = "[" + ranges("".join(m for m in [*I.DIACRITICS, *I.PROSODY] if m not in I.STRESS_MARKS)) + "]"
STRESS_CLASS = f"[{I.STRESS_MARKS}]"
BOUNDARY_CLASS = "[.#‿|‖]"


@cache
def base_class() -> str:
    return "[" + ranges(atoms() + "".join(compounds().values())) + "]"


@cache
def letters() -> str:
    """The ASCII letters among the symbols, which patterns try before all others, as most units are such."""
    return "[" + ranges("".join(c for c in atoms() if c.isascii())) + "]"


def unit_pattern() -> str:
    """One unit: stress, base, marks, and any tied parts with theirs."""
    b = f"(?:{letters()}|{base_class()})"
    return f"{STRESS_CLASS}*{b}{AFTER_CLASS}*(?:[{I.TIE}{I.SEQUENCE}]{b}{AFTER_CLASS}*)*"


def encode(form: Column) -> Column:
    """Tied symbols of the inventory as single characters."""
    for s, c in compounds().items():
        form = F.replace(form, F.lit(s), F.lit(c))
    return form


def decode(form: Column) -> Column:
    for s, c in compounds().items():
        form = F.replace(form, F.lit(c), F.lit(s))
    return form


def _canonical(form: pd.Series) -> pd.Series:
    known = {unicodedata.normalize("NFD", s): s for s in I.phones() if unicodedata.normalize("NFD", s) != s}
    if not known:
        return form.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))
    again = re.compile("|".join(map(re.escape, known)))
    return form.map(lambda x: None if x is None else again.sub(lambda m: known[m[0]], unicodedata.normalize("NFD", x)))


def canonicalize_unicode(form: Column) -> Column:
    """Decomposed, with registered precomposed symbols put together again."""
    return F.pandas_udf(_canonical, T.StringType())(form)


def normalize_lookalikes(form: Column) -> Column:
    return F.translate(form, "".join(I.LOOKALIKES), "".join(I.LOOKALIKES.values()))


def expand_ligatures(form: Column) -> Column:
    for a, b in I.LIGATURES.items():
        form = F.replace(form, F.lit(a), F.lit(b))
    return form


def from_wild(form: Column, ascii_only: bool = False) -> Column:
    """Spellings from outside: decomposed Unicode, look-alikes, ligatures. ascii_only: no accents can occur, so no UDF is needed."""
    return expand_ligatures(normalize_lookalikes(form if ascii_only else canonicalize_unicode(form)))


def tokens(form: Column) -> Column:
    """Units and boundary marks, in order."""
    found = F.regexp_extract_all(encode(form), F.lit(f"({unit_pattern()}|{BOUNDARY_CLASS})"), 1)
    return F.transform(found, decode)


def units(form: Column) -> Column:
    """Units without boundaries."""
    found = lambda x: F.regexp_extract_all(x, F.lit(f"({unit_pattern()})"), 1)
    # a form without ties has no tied symbols, so there is nothing to encode and no unit to decode
    tied = f"[{I.TIE}{I.SEQUENCE}{''.join(compounds().values())}]"
    return F.transform(F.array(form), lambda x: F.when(x.rlike(tied), F.transform(found(encode(x)), decode)).otherwise(found(x)))[0]


def lost(form: Column) -> Column:
    """Characters that no unit, boundary or space accounts for."""
    rest = F.regexp_replace(encode(form), f"{unit_pattern()}|{BOUNDARY_CLASS}|\\s", "")
    return F.filter(F.split(rest, ""), lambda c: c != "")


def segmented(form: Column) -> Column:
    return F.array_join(units(form), " ")


def normalize(segmented_form: Column) -> Column:
    """Units written apart, put together."""
    return F.regexp_replace(segmented_form, r"\s+", "")


def bare(unit: Column) -> Column:
    """A unit without stress, length and tone."""
    marks = "".join(I.PROSODY)
    return F.regexp_replace(unit, f"[{marks}]", "")


def prosody(form: Column) -> Column:
    """(position, glyph) of every prosodic mark, by unit."""
    each = F.transform(units(form), lambda u, i: F.transform(F.regexp_extract_all(u, F.lit("([" + "".join(I.PROSODY) + "])"), 1), lambda g: F.struct(i.cast("long").alias("at"), g.alias("glyph"))))
    return F.flatten(each)


def boundaries(form: Column) -> Column:
    """(at, mark): each boundary and the number of units before it."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<at:bigint,mark:string>>").alias("out"))
    return F.aggregate(
        tokens(form),
        start,
        lambda a, t: F.when(t.rlike(f"^{BOUNDARY_CLASS}$"), F.struct(a["n"].alias("n"), F.array_append(a["out"], F.struct(a["n"].alias("at"), t.alias("mark"))).alias("out"))).otherwise(F.struct((a["n"] + 1).alias("n"), a["out"].alias("out"))),
        lambda a: a["out"],
    )


def parse(form: Column) -> Column:
    """(chain, marks) of each unit: its bases with their ties, and its diacritics and prosody in the order they are written."""
    marks = "[" + "".join([*I.DIACRITICS, *I.PROSODY]) + "]"
    return F.transform(units(form), lambda u: F.struct(F.regexp_replace(u, marks, "").alias("chain"), F.regexp_extract_all(u, F.lit(f"({marks})"), 1).alias("marks")))


def read_strict(form: Column) -> Column:
    """Units of a form; raises an error that names what would be lost."""
    rest = lost(form)
    return F.when(F.size(rest) > 0, F.raise_error(F.concat(F.lit("can't read "), F.array_join(rest, " ")))).otherwise(units(form))


def is_structural(token: Column) -> Column:
    """Whether a token is made of boundary marks and ties only."""
    return token.rlike(f"^(?:{BOUNDARY_CLASS}|[{I.TIE}{I.SEQUENCE}{I.OTHER_MARKS}])+$")


def carries_no_segment(form: Column) -> Column:
    return ~encode(F.coalesce(form, F.lit(""))).rlike(base_class())


def rebuild(unit_array: Column, marks: Column) -> Column:
    """A form from its units and its boundaries (at, mark), as units and boundaries give them."""
    at = lambda i: F.array_join(F.transform(F.filter(marks, lambda b: b["at"] == i), lambda b: b["mark"]), "")
    return F.concat(F.array_join(F.transform(unit_array, lambda u, i: F.concat(at(i), u)), ""), at(F.size(unit_array)))


def import_phoneset(phones: list[str]) -> list[str]:
    """The spellings of an inventory from outside as this one writes them."""
    own = str.maketrans(I.LOOKALIKES | I.LIGATURES)
    return [x.translate(own) for x in _canonical(pd.Series(phones))]


def strip_syllable_breaks(form: Column) -> Column:
    return F.replace(form, F.lit("."), F.lit(""))


def add_ties(form: Column) -> Column:
    """A tie between the two bases of a pair: sequential between vowels, else simultaneous."""
    vowels = "".join(s for s, b in I.stated().items() if len(s) == 1 and b["manner"] == "vowel")
    pair = F.regexp_replace(form, f"^([{vowels}])([{vowels}])$", f"$1{I.SEQUENCE}$2")
    return F.regexp_replace(pair, f"^([{atoms()}])([{atoms()}])$", f"$1{I.TIE}$2")


def tie_glyph_variants(form: Column) -> Column:
    """Respellings with one tie for all."""
    return F.array_distinct(F.array(F.translate(form, I.SEQUENCE, I.TIE), F.translate(form, I.TIE, I.SEQUENCE)))


def stress_to_nucleus(form: Column) -> Column:
    """Syllable-initial stress moved before the nucleus; the consonants passed are marked off by a break."""
    vowels = "".join(s for s, b in I.stated().items() if len(s) == 1 and b["manner"] == "vowel")
    moved = F.regexp_replace(encode(form), f"({STRESS_CLASS})([^{vowels}.#\\s]+)(?=[{vowels}])", ".$2$1")
    return decode(F.regexp_replace(moved, r"^\.|(?<=[.#\s])\.", ""))


def stress_to_syllable(form: Column) -> Column:
    """Nucleus stress moved to the start of its syllable, whose break it replaces."""
    vowels = "".join(s for s, b in I.stated().items() if len(s) == 1 and b["manner"] == "vowel")
    moved = F.regexp_replace(encode(form), f"(^|[.#\\s])([^{vowels}.#\\s]*)({STRESS_CLASS})(?=[{vowels}])", "$1$3$2")
    return decode(F.regexp_replace(moved, f"\\.(?={STRESS_CLASS})", ""))


def findings(form: Column) -> Column:
    """Codes of what is wrong with a transcription; null counts as a form without segments."""
    form = F.coalesce(form, F.lit(""))
    e = encode(form)
    tests = {
        "unknown_symbol": F.size(lost(F.translate(form, I.TIE + I.SEQUENCE + "".join(I.DIACRITICS) + "".join(I.PROSODY) + I.OTHER_MARKS, ""))) > 0,
        "orphan_diacritic": e.rlike(f"(^|{BOUNDARY_CLASS}|\\s){AFTER_CLASS}"),
        "duplicate_diacritic": e.rlike(f"({DIACRITIC_CLASS})\\1"),
        "malformed_tie": e.rlike(f"(^|\\s)[{I.TIE}{I.SEQUENCE}]|[{I.TIE}{I.SEQUENCE}](?:$|\\s|{BOUNDARY_CLASS}|[{I.TIE}{I.SEQUENCE}])"),
        "no_segments": ~e.rlike(base_class()),
    }
    return F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())


def extensions_in(form: Column) -> Column:
    """Symbols of a form that are declared and not on the chart, in order, with repeats. Unknown ones are none: see findings."""
    return F.regexp_extract_all(form, F.lit("([" + "".join(I.OFF_CHART) + "])"), 1)


def is_pure(form: Column) -> Column:
    """Whether a form uses symbols of the chart only, as far as they are known at all; it may not be valid."""
    return F.size(extensions_in(form)) == 0


def is_valid(form: Column) -> Column:
    return F.size(findings(form)) == 0
