"""The phonetic inventory: symbols, features, scales and the places of the vocal tract.

All of it is small, fixed and kept on the driver; it reaches executors as literals or as a broadcast dimension table.
Vowel heights, backness arcs and the rarer consonants are authored from the public IPA chart; place arcs, defaults and
the manner and channel scales are values that published examples fix.
"""

from __future__ import annotations

from functools import cache

# -- fixed values -----------------------------------------------------------------------------------------------------

PLACES = {
    "bilabial": 0.00, "labiodental": 0.03, "dental": 0.08, "alveolar": 0.13, "postalveolar": 0.19, "alveolo-palatal": 0.24,
    "palatal": 0.32, "velar": 0.45, "uvular": 0.56, "pharyngeal": 0.74, "epiglottal": 0.87, "glottal": 1.00,
}
ARTICULATORS = {
    "bilabial": "lower-lip", "labiodental": "lower-lip", "dental": "tongue-tip", "alveolar": "tongue-tip", "postalveolar": "tongue-blade",
    "alveolo-palatal": "tongue-blade", "palatal": "tongue-front", "velar": "tongue-dorsum", "uvular": "tongue-dorsum",
    "pharyngeal": "tongue-root", "epiglottal": "epiglottis", "glottal": "vocal-folds",
}
ARTICULATOR_ARCS = {"lower-lip": 0.00, "tongue-tip": 0.13, "tongue-blade": 0.19, "tongue-front": 0.32, "tongue-dorsum": 0.45, "tongue-root": 0.74, "epiglottis": 0.87, "vocal-folds": 1.00}
#: How closed the tract is; the span of the scale is that from plosive to vowel.
MANNERS = {"plosive": 1.00, "nasal": 1.00, "affricate": 0.90, "trill": 0.90, "tap": 0.90, "fricative": 0.80, "approximant": 0.60, "vowel": 0.40}
HEIGHTS = {"open": 0.00, "near-open": 0.07, "open-mid": 0.13, "mid": 0.20, "close-mid": 0.27, "near-close": 0.33, "close": 0.40}
BACKNESS = {"front": 0.32, "near-front": 0.36, "central": 0.43, "near-back": 0.50, "back": 0.56}
CHANNELS = ["lateral", "flat", "grooved"]
LENGTHS = ["extra-short", "normal", "half-long", "long"]
TONES = ["extra-low", "low", "mid", "high", "extra-high"]
STRESSES = ["unstressed", "secondary", "primary"]
OBSTRUENTS = ("plosive", "fricative", "affricate")

#: Features of every segment unless stated otherwise.
DEFAULTS = {
    "airstream": "pulmonic", "centralized": "-", "channel": "flat", "fronting": "0", "height-mod": "0", "labialized": "-", "labio-palatized": "-",
    "length": "normal", "mid-centralized": "-", "nasalized": "-", "palatalized": "-", "pharyngealized": "-", "retroflex": "-", "rhotacized": "-",
    "rounded": "-", "syllabic": "-", "tongue-root": "0", "velarized": "-",
}
#: Secondary articulations and where they constrict.
SECONDARY = {"labialized": "bilabial", "labio-palatized": "palatal", "palatalized": "palatal", "velarized": "velar", "pharyngealized": "pharyngeal"}
SECONDARY_WEIGHT = 0.5

# symbol: manner place voicing, then other values
_CONSONANTS = """
p plosive bilabial - ; b plosive bilabial + ; t plosive alveolar - ; d plosive alveolar + ; ʈ plosive postalveolar - retroflex=+ ; ɖ plosive postalveolar + retroflex=+
c plosive palatal - ; ɟ plosive palatal + ; k plosive velar - ; ɡ plosive velar + ; q plosive uvular - ; ɢ plosive uvular + ; ʔ plosive glottal - ; ʡ plosive epiglottal -
ȶ plosive alveolo-palatal - ; ȡ plosive alveolo-palatal + ; ť plosive alveolar - palatalized=+
m nasal bilabial + ; ɱ nasal labiodental + ; n nasal alveolar + ; ɳ nasal postalveolar + retroflex=+ ; ɲ nasal palatal + ; ŋ nasal velar + ; ɴ nasal uvular +
ʙ trill bilabial + ; r trill alveolar + ; ʀ trill uvular + ; ⱱ tap labiodental + ; ɾ tap alveolar + ; ɽ tap postalveolar + retroflex=+ ; ɺ tap alveolar + channel=lateral
ɸ fricative bilabial - ; β fricative bilabial + ; f fricative labiodental - ; v fricative labiodental + ; θ fricative dental - ; ð fricative dental +
s fricative alveolar - channel=grooved ; z fricative alveolar + channel=grooved ; ʃ fricative postalveolar - channel=grooved ; ʒ fricative postalveolar + channel=grooved
ʂ fricative postalveolar - channel=grooved retroflex=+ ; ʐ fricative postalveolar + channel=grooved retroflex=+ ; ɕ fricative alveolo-palatal - channel=grooved ; ʑ fricative alveolo-palatal + channel=grooved
ç fricative palatal - ; ʝ fricative palatal + ; x fricative velar - ; ɣ fricative velar + ; χ fricative uvular - ; ʁ fricative uvular + ; ħ fricative pharyngeal - ; ʕ fricative pharyngeal +
ʜ fricative epiglottal - ; ʢ fricative epiglottal + ; h fricative glottal - ; ɦ fricative glottal + ; ɬ fricative alveolar - channel=lateral ; ɮ fricative alveolar + channel=lateral
ɧ fricative postalveolar - velarized=+ ; ʍ fricative bilabial^velar -
ʋ approximant labiodental + ; ɹ approximant alveolar + ; ɻ approximant postalveolar + retroflex=+ ; j approximant palatal + ; ɰ approximant velar + ; w approximant bilabial^velar +
ɥ approximant palatal + labialized=+ ; l approximant alveolar + channel=lateral ; ɭ approximant postalveolar + channel=lateral retroflex=+ ; ʎ approximant palatal + channel=lateral
ʟ approximant velar + channel=lateral ; ɫ approximant alveolar + channel=lateral velarized=+ ; ȴ approximant alveolo-palatal + channel=lateral
ɓ plosive bilabial + airstream=implosive ; ɗ plosive alveolar + airstream=implosive ; ʄ plosive palatal + airstream=implosive ; ɠ plosive velar + airstream=implosive ; ʛ plosive uvular + airstream=implosive
ʘ plosive bilabial - airstream=click ; ǀ plosive dental - airstream=click ; ǃ plosive alveolar - airstream=click ; ǂ plosive palatal - airstream=click ; ǁ plosive alveolar - airstream=click channel=lateral
"""
# symbol: height backness rounding, then other values
_VOWELS = """
i close front - ; y close front + ; ɨ close central - ; ʉ close central + ; ɯ close back - ; u close back + ; ɪ near-close near-front - ; ʏ near-close near-front + ; ʊ near-close near-back +
e close-mid front - ; ø close-mid front + ; ɘ close-mid central - ; ɵ close-mid central + ; ɤ close-mid back - ; o close-mid back + ; ə mid central - ; ɚ mid central - rhotacized=+
ɛ open-mid front - ; œ open-mid front + ; ɜ open-mid central - ; ɝ open-mid central - rhotacized=+ ; ɞ open-mid central + ; ʌ open-mid back - ; ɔ open-mid back +
æ near-open front - ; ɐ near-open central - ; a open front - location=central ; ä open central - ; ɶ open front + ; ɑ open back - ; ɒ open back +
"""
TIE, SEQUENCE = "͡", "͜"
AFFRICATES = ("t͡s", "d͡z", "t͡ʃ", "d͡ʒ", "t͡ɕ", "d͡ʑ", "p͡f", "b͡v", "t͡θ", "d͡ð", "t͡ɬ", "d͡ɮ")
DOUBLES = ("k͡p", "ɡ͡b", "ŋ͡m")
DIPHTHONGS = ("a͜ɪ", "a͜ʊ", "e͜ɪ", "o͜ʊ", "ɔ͜ɪ", "ɪ͜ə", "e͜ə", "ʊ͜ə")
SILENCE = "␣"
ZERO = "∅"

#: What a diacritic states of its host; prefixed with its code point where it combines.
DIACRITICS = {
    "ʰ": {"release": "aspirated"}, "ʱ": {"release": "breathy"}, "ʲ": {"palatalized": "+"}, "ʴ": {"rhotacized": "+"}, "ʷ": {"labialized": "+"},
    "ʼ": {"airstream": "ejective"}, "˞": {"rhotacized": "+"}, "ˠ": {"velarized": "+"}, "ˡ": {"release": "lateral"}, "ˤ": {"pharyngealized": "+"},
    "̃": {"nasalized": "+"}, "̈": {"centralized": "+"}, "̘": {"tongue-root": "advanced"}, "̙": {"tongue-root": "retracted"},
    "̚": {"release": "none"}, "̜": {"rounding": "less"}, "̝": {"height-mod": "raised"}, "̞": {"height-mod": "lowered"},
    "̟": {"fronting": "advanced"}, "̠": {"fronting": "retracted"}, "̤": {"phonation": "breathy"}, "̥": {"voiced": "-"},
    "̩": {"syllabic": "+"}, "̪": {"place": "dental"}, "̬": {"voiced": "+"}, "̯": {"syllabic": "non"}, "̰": {"phonation": "creaky"},
    "̴": {"velarized": "+"}, "̹": {"rounding": "more"}, "̺": {"apicality": "apical"}, "̻": {"apicality": "laminal"},
    "̼": {"linguolabial": "+"}, "̽": {"mid-centralized": "+"}, "ᶣ": {"labio-palatized": "+"}, "ⁿ": {"release": "nasal"}, "ʻ": {"release": "aspirated"},
    "ˀ": {"release": "glottal"}, "ᵊ": {"release": "schwa"},
}
#: Prosodic marks: feature and value; stress is written before its unit, the rest after it.
PROSODY = {
    "ˈ": ("stress", "primary"), "ˌ": ("stress", "secondary"), "ː": ("length", "long"), "ˑ": ("length", "half-long"), "̆": ("length", "extra-short"),
    "˥": ("tone", "extra-high"), "˦": ("tone", "high"), "˧": ("tone", "mid"), "˨": ("tone", "low"), "˩": ("tone", "extra-low"),
    "́": ("tone", "high"), "̄": ("tone", "mid"), "̀": ("tone", "low"), "̌": ("tone", "low>high"), "̂": ("tone", "high>low"),
    "᷄": ("tone", "mid>high"), "᷅": ("tone", "low>mid"), "᷆": ("tone", "mid>low"), "᷇": ("tone", "high>mid"), "᷈": ("tone", "low>high>low"), "᷉": ("tone", "high>low>high"),
}
STRESS_MARKS = "ˈˌ"
#: Boundary marks, weakest first in the ladder syllable < word < phrase < utterance.
LADDER = ("syllable", "word", "phrase", "utterance")
BOUNDARIES = {".": "syllable", "#": "word", "‿": "word", "|": "phrase", "‖": "utterance"}
OTHER_MARKS = "↗↘ꜛꜜ^"
#: Symbols that mean something here and aren't on the chart, with the notation they belong to.
CHART = "chart"
OFF_CHART = {"␣": "extension", "#": "extension", "∅": "extension"}
#: Look-alikes that keyboards write.
LOOKALIKES = {"g": "ɡ", ":": "ː", "?": "ʔ", "'": "ˈ"}
LIGATURES = {"ʦ": "t͡s", "ʣ": "d͡z", "ʧ": "t͡ʃ", "ʤ": "d͡ʒ", "ʨ": "t͡ɕ", "ʥ": "d͡ʑ"}

#: Named classes of feature values that a bare term may name.
CLASSES = {"obstruent": ("manner", OBSTRUENTS), "sonorant": ("manner", ("nasal", "approximant", "tap", "trill", "vowel"))}


# -- derived ----------------------------------------------------------------------------------------------------------


def _read(block: str, names: tuple[str, ...], common: dict[str, str]) -> dict[str, dict[str, str]]:
    out = {}
    for row in block.replace("\n", ";").split(";"):
        if parts := row.split():
            out[parts[0]] = common | dict(zip(names, parts[1:4], strict=True)) | dict(p.split("=") for p in parts[4:])
    return out


@cache
def stated() -> dict[str, dict[str, str]]:
    """Features that each atomic or compound symbol states, in the order of the inventory."""
    out = {SILENCE: {"manner": "silence"}}
    out |= _read(_CONSONANTS, ("manner", "place", "voiced"), {})
    for symbol, bundle in _read(_VOWELS, ("height", "backness", "rounded"), {"manner": "vowel", "voiced": "+"}).items():
        out[symbol] = bundle
    for unit in AFFRICATES:
        stop, fric = unit.split(TIE)
        out[unit] = {k: v for k, v in out[fric].items()} | {"manner": "affricate", "voiced": out[stop]["voiced"]}
    for unit in DOUBLES:
        first, second = unit.split(TIE)
        out[unit] = out[first] | {"place": f"{out[second]['place']}^{out[first]['place']}"}
    for unit in DIPHTHONGS:
        first, second = unit.split(SEQUENCE)
        out[unit] = out[first] | {"glide-height": out[second]["height"], "glide-backness": out[second]["backness"]}
    return out


@cache
def full() -> dict[str, dict[str, str]]:
    """The same with defaults filled in; silence has none."""
    return {s: (b if s == SILENCE else DEFAULTS | b) for s, b in stated().items()}


def notation_of(symbol: str) -> str:
    """The notation that a symbol belongs to; one that isn't known counts as on the chart, as validity is another question."""
    return OFF_CHART.get(symbol, CHART)


@cache
def phones() -> tuple[str, ...]:
    return tuple(stated())


def speech() -> tuple[str, ...]:
    return tuple(s for s in phones() if s != SILENCE)


@cache
def values() -> dict[str, tuple[str, ...]]:
    """Feature: its values, in the order of their scale where they have one."""
    ordered = {
        "manner": [*sorted(MANNERS, key=MANNERS.get), "silence"], "place": [*PLACES], "height": [*HEIGHTS], "backness": [*BACKNESS], "channel": CHANNELS,
        "length": LENGTHS, "tone": TONES, "stress": STRESSES, "voiced": ["-", "+"],
    }
    out: dict[str, list[str]] = {k: list(v) for k, v in ordered.items()}
    for bundle in [*full().values(), *DIACRITICS.values(), *({f: v} for f, v in PROSODY.values())]:
        for f, v in bundle.items():
            if v not in out.setdefault(f, []):
                out[f].append(v)
    return {f: tuple(v) for f, v in out.items()}


def value_distance(feature: str, a: str, b: str) -> float:
    """Distance of two values on the scale of their feature: by anchors over the span, by rank, or 0 and 1."""
    if a == b:
        return 0.0
    if "^" in a or "^" in b:
        xs, ys = a.split("^"), b.split("^")
        one = sum(min(value_distance(feature, x, y) for y in ys) for x in xs) / len(xs)
        two = sum(min(value_distance(feature, x, y) for x in xs) for y in ys) / len(ys)
        return max(one, two)
    anchors = {"manner": MANNERS, "place": PLACES, "height": HEIGHTS, "backness": BACKNESS}.get(feature)
    if anchors and a in anchors and b in anchors:
        return abs(anchors[a] - anchors[b]) / (max(anchors.values()) - min(anchors.values()))
    ranks = {"channel": CHANNELS, "length": LENGTHS, "tone": TONES, "stress": STRESSES}.get(feature)
    if ranks and a in ranks and b in ranks:
        return abs(ranks.index(a) - ranks.index(b)) / (len(ranks) - 1)
    return 1.0


def overlay(base: dict[str, str], mark: str) -> dict[str, str]:
    """Features with those of a diacritic, which replace what they contradict."""
    return base | DIACRITICS.get(mark, {})


def bundle_of(unit: str) -> dict[str, str] | None:
    """Features of a written unit: a symbol with diacritics and prosody; None if it can't be read."""
    body = unit.strip(STRESS_MARKS)
    known = full()
    for n in range(len(body), 0, -1):
        if body[:n] in known:
            out, rest = dict(known[body[:n]]), body[n:]
            break
    else:
        return None
    for mark in rest:
        if mark in DIACRITICS:
            out |= DIACRITICS[mark]
        elif mark in PROSODY:
            out[PROSODY[mark][0]] = PROSODY[mark][1]
        else:
            return None
    for mark in unit[: len(unit) - len(unit.lstrip(STRESS_MARKS))]:
        out["stress"] = PROSODY[mark][1]
    return out
