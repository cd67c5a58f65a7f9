"""Units as structures of constituents: their bundles, phases, kinds and projections, as column expressions.

A structure is (constituents (base, modifiers, approach), junctures, prosody); junctures are ``fuse`` (one timing slot) or
``seq`` (several). The inventory and the marks are map literals, so nothing is joined and nothing leaves the JVM. A unit that
can't be read has no structure: null, as are all reads of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import inventory as I
from . import text as X

FUSE, SEQ = "fuse", "seq"
WIRE_TYPE, WIRE_VERSION = "ipa-segment", 3
_BUNDLE = "map<string,string>"
_CONSTITUENT = "struct<base:string,modifiers:array<string>,approach:array<string>>"
_SPAN = "array<struct<start:int,end:int>>"
#: Features whose two values are the presence and the absence of an articulation; where constituents in no order differ, it is absent.
_BINARY = ("centralized", "labialized", "labio-palatized", "mid-centralized", "nasalized", "palatalized", "pharyngealized", "retroflex", "rhotacized", "rounded", "syllabic", "velarized", "voiced")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _table(rows: dict, kind: str) -> Column:
    """A map of the driver's as a literal."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), kind)


def _bases(defaults: bool) -> Column:
    own = I.full() if defaults else I.stated()
    return _table({s: b for s, b in own.items() if len(s) == 1}, f"map<string,{_BUNDLE}>")


def _marks() -> Column:
    return _table(I.DIACRITICS, f"map<string,{_BUNDLE}>")


def overlay(bundle: Column, more: Column) -> Column:
    """bundle with the values of more, which win."""
    return F.map_concat(F.map_filter(bundle, lambda k, v: ~F.map_contains_key(more, k)), more)


def structure(unit: Column) -> Column:
    """The structure of a written unit."""
    body = X.bare(unit)
    parts = F.split(body, f"[{I.TIE}{I.SEQUENCE}]")
    junctures = F.transform(F.regexp_extract_all(body, F.lit(f"([{I.TIE}{I.SEQUENCE}])"), 1), lambda t: F.when(t == I.TIE, FUSE).otherwise(SEQ))
    letters = X.atoms()
    split = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    one = lambda p: F.struct(F.regexp_extract(p, f"([{letters}])", 1).alias("base"), split(F.regexp_extract(p, f"[{letters}](.*)$", 1)).alias("modifiers"), split(F.regexp_extract(p, f"^([^{letters}]*)", 1)).alias("approach"))
    prosody = F.regexp_extract_all(unit, F.lit("([" + "".join(I.PROSODY) + "])"), 1)
    known = "[" + "".join(I.DIACRITICS) + "]*"
    good = F.forall(parts, lambda p: p.rlike(f"^{known}[{letters}]{known}$"))
    return F.when(good, F.struct(F.transform(parts, one).alias("constituents"), junctures.alias("junctures"), prosody.alias("prosody")))


def build_segment(parts: Column, senses: Column, prosody: Column) -> Column:
    """A structure from spelled parts, the senses of the ties between them and prosodic marks; null unless there is one tie fewer
    than parts."""
    tied = F.aggregate(F.arrays_zip(F.slice(parts, 2, F.size(parts)).alias("p"), senses.alias("s")), parts[0], lambda a, x: F.concat(a, F.when(x["s"] == FUSE, I.TIE).otherwise(I.SEQUENCE), x["p"]))
    return F.when(F.size(senses) == F.size(parts) - 1, let(structure(tied), lambda s: s.withField("prosody", prosody)))


def spelling(s: Column) -> Column:
    """The unit as written, without its prosody."""
    word = lambda c: F.concat(F.array_join(c["approach"], ""), c["base"], F.array_join(c["modifiers"], ""))
    tie = lambda i: F.when(i == 0, "").when(F.get(s["junctures"], i - 1) == FUSE, I.TIE).otherwise(I.SEQUENCE)
    return F.array_join(F.transform(s["constituents"], lambda c, i: F.concat(tie(i), word(c))), "")


def to_ipa(s: Column) -> Column:
    """The unit as written: stress before it, other prosody after it."""
    stress = F.filter(s["prosody"], lambda m: m.isin(*I.STRESS_MARKS))
    return F.concat(F.array_join(stress, ""), spelling(s), F.array_join(F.array_except(s["prosody"], stress), ""))


def unmarked(s: Column) -> Column:
    """Bases and junctures only."""
    none = F.array().cast("array<string>")
    return F.struct(F.transform(s["constituents"], lambda c: F.struct(c["base"].alias("base"), none.alias("modifiers"), none.alias("approach"))).alias("constituents"), s["junctures"].alias("junctures"), none.alias("prosody"))


def bundles(s: Column, defaults: bool = True) -> Column:
    """The bundle of each constituent: its base's features, and those that its marks state in their order."""
    bases, marks = _bases(defaults), _marks()
    return F.transform(s["constituents"], lambda c: F.aggregate(c["modifiers"], F.try_element_at(bases, c["base"]), lambda b, m: overlay(b, F.try_element_at(marks, m))))


def bag(bs: Column) -> Column:
    """feature: its distinct values, in the order of the constituents."""
    keys = F.array_distinct(F.flatten(F.transform(bs, lambda b: F.map_keys(b))))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.array_distinct(F.filter(F.transform(bs, lambda b: F.try_element_at(b, k)), lambda v: v.isNotNull())))))


def disagreements(bs: Column) -> Column:
    """Of the bag, the features with several values."""
    return F.map_filter(bag(bs), lambda k, v: F.size(v) > 1)


def _spans(starts: Column, n: Column) -> Column:
    return F.transform(starts, lambda s, i: F.struct(s.cast("int").alias("start"), F.coalesce(F.get(starts, i + 1), n).cast("int").alias("end")))


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def phase_blocks(bs: Column) -> Column:
    """(start, end) of the runs of constituents of one manner."""
    manner = lambda i: F.try_element_at(F.get(bs, i), F.lit("manner"))
    return _spans(F.filter(_places(F.size(bs)), lambda i: (i == 0) | ~manner(i).eqNullSafe(manner(i - 1))), F.size(bs))


def phased(bs: Column, junctures: Column) -> Column:
    """Whether the constituents stand in an order that means something: in time, or in phases."""
    return F.array_contains(junctures, SEQ) | (F.size(phase_blocks(bs)) > 1)


def children(bs: Column, junctures: Column) -> Column:
    """(start, end) of the parts at the top: runs between sequential junctures, else phases, else constituents; none if atomic."""
    n = F.size(bs)
    runs = _spans(F.filter(_places(n), lambda i: (i == 0) | (F.get(junctures, i - 1) == SEQ)), n)
    return (
        F.when(bs.isNull(), None)
        .when(n < 2, F.array().cast(_SPAN))
        .when(F.array_contains(junctures, SEQ), runs)
        .otherwise(let(phase_blocks(bs), lambda b: F.when(F.size(b) > 1, b).otherwise(_spans(_places(n), n))))
    )


def combine(feature: Column, values: Column) -> Column:
    """The combining spelling of several values, by their order on the feature's scale."""
    scale = _table({f: list(vs) for f, vs in I.values().items()}, "map<string,array<string>>")
    each = F.array_distinct(F.flatten(F.transform(values, lambda v: F.split(v, r"\^"))))
    ranked = F.array_sort(F.transform(each, lambda v: F.struct(F.array_position(F.try_element_at(scale, feature), v).alias("at"), v.alias("v"))))
    return F.array_join(F.transform(ranked, lambda r: r["v"]), "^")


def combining_place(bs: Column) -> Column:
    """The place of a fusion of one phase that constricts in several; null otherwise."""
    places = F.array_distinct(F.filter(F.transform(bs, lambda b: F.try_element_at(b, F.lit("place"))), lambda p: p.isNotNull()))
    return F.when(F.size(phase_blocks(bs)) == 1, let(places, lambda p: F.when(F.size(p) > 1, combine(F.lit("place"), p))))


def simultaneous_merge(bs: Column) -> Column:
    """One bundle of constituents in no order: a value that all who state it share; where they differ the absence of a binary
    feature, else the values combined."""
    return F.map_from_entries(
        F.transform(F.map_entries(bag(bs)), lambda e: F.struct(e["key"], F.when(F.size(e["value"]) == 1, e["value"][0]).when(e["key"].isin(*_BINARY), "-").otherwise(combine(e["key"], e["value"]))))
    )


def classify(bs: Column, junctures: Column) -> Column:
    """The kind of a unit: atomic, diphthong, chain, click-accompaniment, double-articulation, overlay, affricate, prenasalized,
    pre-stopped or lateral-release. A sequence comes before a fusion, an airstream before a manner, one phase before several."""
    at = lambda b, f: F.try_element_at(b, F.lit(f))

    def by_phase(blocks: Column) -> Column:
        first, second = (at(F.get(bs, F.get(blocks, k)["start"]), "manner") for k in (0, 1))
        lateral = F.exists(F.slice(bs, blocks[1]["start"] + 1, blocks[1]["end"] - blocks[1]["start"]), lambda b: at(b, "channel") == "lateral")
        return (
            F.when((first == "plosive") & (second == "fricative"), "affricate")
            .when((first == "nasal") & second.isin(*I.OBSTRUENTS), "prenasalized")
            .when(first.isin(*I.OBSTRUENTS) & (second == "nasal"), "pre-stopped")
            .when((first == "plosive") & (second == "approximant") & lateral, "lateral-release")
            .otherwise("overlay")
        )

    return (
        F.when(bs.isNull(), None)
        .when(F.size(bs) == 1, "atomic")
        .when(F.array_contains(junctures, SEQ), F.when(F.forall(bs, lambda b: at(b, "manner") == "vowel"), "diphthong").otherwise("chain"))
        .when(F.exists(bs, lambda b: at(b, "airstream") == "click"), "click-accompaniment")
        .otherwise(let(phase_blocks(bs), lambda p: F.when(F.size(p) > 1, by_phase(p)).otherwise(F.when(combining_place(bs).isNotNull(), "double-articulation").otherwise("overlay"))))
    )


def project(bs: Column, junctures: Column) -> Column:
    """The flat bundle of a unit. Of a sequence the first run counts. Constituents in phases are laid over each other in order, the
    last wins; those in no order are merged. An affricate has that manner, and a fusion in two places their combination."""
    cut = F.when(F.array_contains(junctures, SEQ), F.array_position(junctures, SEQ).cast("int")).otherwise(F.size(bs))
    own = F.slice(bs, 1, cut)

    def flat(x: Column) -> Column:
        ordered = F.aggregate(x, F.create_map().cast(_BUNDLE), overlay)
        merged = F.when(F.size(phase_blocks(x)) > 1, ordered).otherwise(simultaneous_merge(x))
        fused = F.slice(junctures, 1, F.size(x) - 1)
        named = F.map_filter(F.create_map(F.lit("manner"), F.when(classify(x, fused) == "affricate", "affricate"), F.lit("place"), combining_place(x)), lambda k, v: v.isNotNull())
        return overlay(merged, named)

    return let(own, flat)


def scalar(s: Column, defaults: bool = True) -> Column:
    """The flat bundle of a structure; what it leaves unstated is filled with defaults afterwards."""
    flat = let(bundles(s, False), lambda bs: project(bs, s["junctures"]))
    if not defaults:
        return flat
    filled = _table(I.DEFAULTS, _BUNDLE)
    return let(flat, lambda b: F.when(F.try_element_at(b, F.lit("manner")) == "silence", b).otherwise(overlay(filled, b)))


def part(s: Column, start: Column, end: Column) -> Column:
    """Constituents start .. end - 1 as a structure without prosody."""
    none = F.array().cast("array<string>")
    return F.struct(F.slice(s["constituents"], start + 1, end - start).alias("constituents"), F.slice(s["junctures"], start + 1, F.greatest(end - start - 1, F.lit(0))).alias("junctures"), none.alias("prosody"))


def edge_features(s: Column, last: bool = False, defaults: bool = True) -> Column:
    """The flat bundle of the first or last part at the top; of an atomic unit its own."""
    spans = let(bundles(s, False), lambda bs: children(bs, s["junctures"]))
    at = let(spans, lambda c: F.when(F.size(c) > 0, F.element_at(c, -1 if last else 1)).otherwise(F.struct(F.lit(0).alias("start"), F.size(s["constituents"]).alias("end"))))
    return let(let(at, lambda a: part(s, a["start"], a["end"])), lambda p: scalar(p, defaults))


def features_at(s: Column, index: int, defaults: bool = True) -> Column:
    """The flat bundle of the part at the top with a number from 0; null beyond the last."""
    spans = let(bundles(s, False), lambda bs: children(bs, s["junctures"]))
    return let(let(spans, lambda c: F.get(c, index)), lambda a: F.when(a.isNotNull(), let(part(s, a["start"], a["end"]), lambda p: scalar(p, defaults))))


def segment_to_json(s: Column) -> Column:
    """Versioned wire text of a structure."""
    return F.when(s.isNotNull(), F.to_json(F.struct(F.lit(WIRE_TYPE).alias("type"), F.lit(WIRE_VERSION).alias("v"), s["constituents"].alias("constituents"), s["junctures"].alias("junctures"), s["prosody"].alias("prosody"))))


def segment_from_json(wire: Column) -> Column:
    """The structure of a wire text; null for another type or version, prosody that is none, or a wrong number of junctures."""
    x = F.from_json(wire, f"type string, v int, constituents array<{_CONSTITUENT}>, junctures array<string>, prosody array<string>")
    good = (x["type"] == WIRE_TYPE) & (x["v"] == WIRE_VERSION) & (F.size(x["junctures"]) == F.size(x["constituents"]) - 1) & F.forall(x["prosody"], lambda m: m.isin(*I.PROSODY)) & F.forall(x["junctures"], lambda j: j.isin(FUSE, SEQ))
    return F.when(good, F.struct(x["constituents"].alias("constituents"), x["junctures"].alias("junctures"), x["prosody"].alias("prosody")))


# -- values -----------------------------------------------------------------------------------------------------------


def expand(value: Column) -> Column:
    """Components of a combining value."""
    return F.split(value, r"\^")


def steps(value: Column) -> Column:
    """Steps of a sequence value, such as a tone contour."""
    return F.split(value, ">")


def sequenced(value: Column) -> Column:
    return value.contains(">")


def move(feature: str, value: Column, by: int) -> Column:
    """The value so many steps up the feature's scale; null beyond its ends."""
    own = F.array(*map(F.lit, I.values()[feature]))
    at = F.array_position(own, value)
    return F.when((at > 0) & (at + by > 0), F.try_element_at(own, (at + by).cast("int")))


def prosody_of(s: Column) -> Column:
    """feature: value of the prosody of a structure; of several marks for one feature the last counts."""
    marks = _table({m: {"f": f, "v": v} for m, (f, v) in I.PROSODY.items()}, "map<string,struct<f:string,v:string>>")
    one = lambda m: F.create_map(F.try_element_at(marks, m)["f"], F.try_element_at(marks, m)["v"])
    return F.aggregate(s["prosody"], F.create_map().cast(_BUNDLE), lambda a, m: overlay(a, one(m)))


def raised_prominence(s: Column) -> Column:
    """Whether a structure is stressed."""
    return F.exists(s["prosody"], lambda m: m.isin(*I.STRESS_MARKS))


def is_nucleus(s: Column) -> Column:
    """Vowels that aren't marked as non-syllabic, and what is marked as syllabic."""
    return let(scalar(s), lambda b: F.coalesce(F.when(F.try_element_at(b, F.lit("syllabic")) == "+", True).when(F.try_element_at(b, F.lit("syllabic")) == "non", False).otherwise(F.try_element_at(b, F.lit("manner")) == "vowel"), F.lit(False)))


def with_prosody(unit: Column, marks: Column) -> Column:
    """The unit with further prosodic marks (an array), stress before it."""
    return let(structure(unit), lambda s: to_ipa(s.withField("prosody", F.array_union(s["prosody"], marks))))
