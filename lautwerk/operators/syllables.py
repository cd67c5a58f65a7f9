"""Syllables by declared languages: licensed onsets and codas, edges, residue, and all readings of a form.

A language is declared by spans of feature terms: its nuclei, onsets, codas. Over the classes of units (see automaton) each
kind is a regular expression. Between two nuclei the break goes before the longest licensed onset; at the start of a word
stands the longest licensed suffix, at its end the longest licensed coda, and what is left over there is residue. Every
way to divide the consonants between nuclei into a coda and an onset that are licensed, or empty, is a reading.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import text as X
from ..plans import automaton as T
from ..plans import patterns as P
from ..plans.terms import QueryError

STRATA = ("native", "borrowing", "marginal")


@dataclass(frozen=True)
class Language:
    """Spans are sequences of terms; no coda at all licenses every coda."""

    name: str
    nuclei: tuple[str, ...] = ("[vowel]",)
    onsets: tuple[str, ...] = ("[-vowel]",)
    codas: tuple[str, ...] = ()
    strata: dict[str, str] = field(default_factory=dict, compare=False)

    def strict(self) -> Language:
        """The language without what isn't native to it."""
        native = lambda spans: tuple(s for s in spans if self.strata.get(s, "native") == "native")
        return Language(self.name, self.nuclei, native(self.onsets), native(self.codas), self.strata)


SPANISH = Language("spanish", onsets=("[-vowel]", "[obstruent] [manner=tap]", "[obstruent] [manner=trill]", "[obstruent] [channel=lateral]"))


def read_languages(table: DataFrame) -> dict[str, Language]:
    """Languages of a table (language, kind, ordinal, span, stratum): a declaration is a handful of rows, read on the driver."""
    out: dict[str, dict] = {}
    for r in table.select("language", "kind", "ordinal", "span", "stratum").orderBy("language", "kind", "ordinal").collect():
        own = out.setdefault(r["language"], {"nucleus": [], "onset": [], "coda": [], "strata": {}})
        if r["kind"] not in own or r["kind"] == "strata":
            raise QueryError(f"a span is a nucleus, an onset or a coda, not {r['kind']!r}")
        if r["stratum"] not in (None, *STRATA):
            raise QueryError(f"no stratum {r['stratum']!r}")
        own[r["kind"]].append(r["span"])
        own["strata"][r["span"]] = r["stratum"] or "native"
    return {name: Language(name, tuple(x["nucleus"]) or ("[vowel]",), tuple(x["onset"]), tuple(x["coda"]), x["strata"]) for name, x in out.items()}


class _Spans:
    """Regular expressions over classes for the spans of a language."""

    def __init__(self, language: Language) -> None:
        self.language = language
        items = [P._items(s) for s in (*language.nuclei, *language.onsets, *language.codas)]
        self.classes = T.Classes(P.Pattern(P.Item("any", ""), tuple(x for s in items for x in s), ()), {})
        own = lambda spans: [P._items(s) for s in sorted(spans, key=lambda s: -len(P._items(s)))]
        text = lambda spans: "|".join("".join(self.classes.item(x) for x in s) for s in own(spans)) or "(?!)"
        if any(len(P._items(s)) != 1 for s in language.nuclei):
            raise QueryError("a nucleus is one unit")
        self.nucleus = f"(?:{text(language.nuclei)})"
        self.unit = self.classes.item(P.Item("any", ""))
        self.consonant = f"(?:(?!{self.nucleus}){self.unit})"
        self.onset = f"(?:{text(language.onsets)})"
        self.coda = f"(?:{text(language.codas)})" if language.codas else f"{self.consonant}*"


BREAK, LEFT_OVER = T.SITE, T.ENDS


def _divided(s: Column, x: _Spans) -> Column:
    """A class string with BREAK before syllables, and LEFT_OVER around the residue of words."""
    s = F.regexp_replace(s, f"(?<={x.nucleus})({x.consonant}*?)({x.onset}?)(?={x.nucleus})", f"$1{BREAK}$2")
    units, edge = f"{x.unit}", f"(?<!{x.unit}|{BREAK}|{LEFT_OVER})"
    s = F.regexp_replace(s, f"{edge}({x.consonant}*?)({x.onset}?)(?={x.nucleus})", f"$1{BREAK}$2")
    s = F.regexp_replace(s, f"(?<={x.nucleus})((?:{x.coda})?+)({x.consonant}+)(?!{units}|{BREAK})", f"$1{LEFT_OVER}$2")
    return s


def syllabify(form: Column, language: Language = SPANISH) -> Column:
    """(syllables, residue) of a form, each (start, end, text) in units; written breaks are derived anew, other boundaries end words.
    Words without a nucleus are residue."""
    x = _Spans(language)
    clean = F.regexp_replace(X.encode(form), r"\.", "")
    kind = "array<struct<start:bigint,end:bigint,text:string>>"

    def whole(t: Column) -> Column:
        # parts that begin with BREAK are syllables; what else has units is residue
        marked = F.regexp_replace(_divided(T.class_string(t, x.classes), x), f"([^{_units(x)}{BREAK}{LEFT_OVER}]+)", f"{LEFT_OVER}$1{LEFT_OVER}")
        parts = F.split(F.regexp_replace(marked, f"{BREAK}", f"{LEFT_OVER}{BREAK}"), LEFT_OVER)
        start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("u"), F.array().cast(kind).alias("yes"), F.array().cast(kind).alias("no"))

        def step(a: Column, p: Column) -> Column:
            body = F.replace(p, F.lit(BREAK), F.lit(""))
            size = F.length(body)
            units = F.length(F.regexp_replace(body, f"[^{_units(x)}]", "")).cast("bigint")
            span = F.struct(a["u"].alias("start"), (a["u"] + units).alias("end"), X.decode(T.joined(t, a["n"], size)).alias("text"))
            add = lambda to, when: F.when(when & (units > 0), F.array_append(a[to], span)).otherwise(a[to])
            return F.struct((a["n"] + size).alias("n"), (a["u"] + units).alias("u"), add("yes", p.startswith(BREAK)).alias("yes"), add("no", ~p.startswith(BREAK)).alias("no"))

        return F.aggregate(parts, start, step, lambda a: F.struct(a["yes"].alias("syllables"), a["no"].alias("residue")))

    return F.when(form.isNotNull(), A.let(T.tokens_of(clean), whole))


def _units(x: _Spans) -> str:
    return x.unit[1:-1]


def tiers(form: Column, language: Language = SPANISH) -> Column:
    """The syllables of a form as intervals (tier, start, end), for patterns that name the tier, and its words."""
    syllables = F.transform(syllabify(form, language)["syllables"], lambda s: F.struct(F.lit("syllable").alias("tier"), s["start"].alias("start"), s["end"].alias("end")))
    return F.concat(syllables, word_tier(form))


def word_tier(form: Column) -> Column:
    """The words of a form as intervals (tier, start, end), without its syllables."""
    words = F.split(F.regexp_replace(X.encode(form), r"\.", ""), r"[#‿|‖\s]")
    start = F.struct(F.lit(0).cast("bigint").alias("u"), F.array().cast("array<struct<tier:string,start:bigint,end:bigint>>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        n = (F.length(w) if X.is_plain() else F.size(F.regexp_extract_all(w, F.lit(f"({X.unit_pattern()})"), 1))).cast("bigint")
        span = F.struct(F.lit("word").alias("tier"), a["u"].alias("start"), (a["u"] + n).alias("end"))
        return F.struct((a["u"] + n).alias("u"), F.when(n > 0, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(words, start, step, lambda a: a["out"])


def _runs(form: Column, x: _Spans) -> Column:
    """The consonants of a word before, between and after its nuclei, as classes."""
    clean = F.regexp_replace(X.encode(form), r"\.", "")
    return F.split(A.let(T.tokens_of(clean), lambda t: T.class_string(t, x.classes)), x.nucleus)


def _splits(run: Column, x: _Spans) -> Column:
    """Lengths of the codas with which a run between nuclei can be divided."""
    places = F.sequence(F.lit(0), F.length(run))
    good = lambda k: F.substring(run, F.lit(1), k).rlike(f"^{x.coda}?$") & F.substring(run, k + 1, F.length(run)).rlike(f"^{x.onset}?$")
    return F.filter(places, good)


def count_readings(form: Column, language: Language = SPANISH) -> Column:
    """How many ways there are to divide a word (a form without other boundaries than breaks) into syllables without residue; 0 for a
    word without a nucleus, null for null. A forward recursion over the runs between nuclei."""
    x = _Spans(language)

    def ways(r: Column) -> Column:
        edges = r[0].rlike(f"^{x.onset}?$") & F.element_at(r, -1).rlike(f"^{x.coda}?$")
        inner = F.slice(r, 2, F.size(r) - 2)
        counted = F.aggregate(inner, F.lit(1).cast("bigint"), lambda n, run: n * F.size(_splits(run, x)).cast("bigint"))
        return F.when((F.size(r) > 1) & edges, counted).otherwise(F.lit(0).cast("bigint"))

    return F.when(form.isNotNull(), A.let(_runs(form, x), ways))


def readings(form: Column, language: Language = SPANISH) -> Column:
    """All those ways, as arrays of the lengths of codas between nuclei, shortest first; as many as count_readings says."""
    x = _Spans(language)
    one = lambda r: F.aggregate(
        F.slice(r, 2, F.size(r) - 2), F.array(F.array().cast("array<int>")), lambda acc, run: F.flatten(F.transform(acc, lambda a: F.transform(_splits(run, x), lambda k: F.array_append(a, k))))
    )
    none = F.array().cast("array<array<int>>")
    return F.when(form.isNotNull(), A.let(_runs(form, x), lambda r: F.when((F.size(r) > 1) & r[0].rlike(f"^{x.onset}?$") & F.element_at(r, -1).rlike(f"^{x.coda}?$"), one(r)).otherwise(none)))
