"""Conversion between notations: longest match first, as one extraction and one lookup for each symbol."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import inventory as I
from . import algebra as A
from . import text as X

# Correspondences of the public notations, as "IPA target" pairs in their published order.
CMU = (
    "␣ SIL i IY ɪ IH ɛ EH æ AE ɑ AA ɔ AO ʊ UH u UW ʌ AH ə AH ɚ ER ɝ ER e͜ɪ EY o͜ʊ OW a͜ɪ AY a͜ʊ AW ɔ͜ɪ OY j Y w W m M n N ŋ NG l L ɹ R p P b B t T d D k K ɡ G "
    "t͡ʃ CH d͡ʒ JH f F v V θ TH ð DH s S z Z ʃ SH ʒ ZH h HH"
)
CMU_EXTRAS = "ə AX ʔ Q ɾ DX ɾ̃ NX ɨ IX l̩ EL m̩ EM n̩ EN ŋ̩ ENG"
TIMIT = (
    "␣ h# i iy ɪ ih ɛ eh æ ae ɑ aa ɔ ao ʊ uh u uw ʌ ah ə ax ɚ axr ɝ er ɨ ix e͜ɪ ey o͜ʊ ow a͜ɪ ay a͜ʊ aw ɔ͜ɪ oy j y w w ɹ r l l m m n n ŋ ng m̩ em n̩ en ŋ̩ eng "
    "f f v v θ th ð dh s s z z ʃ sh ʒ zh h hh ɦ hv t͡ʃ ch d͡ʒ jh p p b b t t d d k k ɡ g ʔ q ɾ dx ɾ̃ nx l̩ el"
)
#: Closures and pauses that are read but never written.
TIMIT_READ = "p pcl b bcl t tcl d dcl k kcl ɡ gcl ʔ epi ␣ pau"
XSAMPA = (
    "# # . . a a b b c c d d e e f f h h i i j j k k l l m m n n o o p p q q r r s s t t u u v v w w x x y y z z | | ä a_\" æ { ç C ð D ø 2 ħ X\\ ŋ N œ 9 "
    "ť t_> ǀ |\\ ǁ |\\|\\ ǂ =\\ ǃ !\\ ȡ d_j\\ ȴ l_j\\ ȶ t_j\\ ɐ 6 ɑ A ɒ Q ɓ b_< ɔ O ɕ s\\ ɖ d` ɗ d_< ɘ @\\ ə @ ɚ @` ɛ E ɜ 3 ɝ 3` ɞ 3\\ ɟ J\\ ɠ g_< ɡ g ɢ G\\ ɣ G ɤ 7 ɥ H "
    "ɦ h\\ ɧ x\\ ɨ 1 ɪ I ɫ 5 ɬ K ɭ l` ɮ K\\ ɯ M ɰ M\\ ɱ F ɲ J ɳ n` ɴ N\\ ɵ 8 ɶ & ɸ p\\ ɹ r\\ ɺ l\\ ɻ r\\` ɽ r` ɾ 4 ʀ R\\ ʁ R ʂ s` ʃ S ʄ J\\_< ʈ t` ʉ } ʊ U ʋ P ʌ V ʍ W "
    "ʎ L ʏ Y ʐ z` ʑ z\\ ʒ Z ʔ ? ʕ ?\\ ʘ O\\ ʙ B\\ ʛ G\\_< ʜ H\\ ʝ j\\ ʟ L\\ ʡ >\\ ʢ <\\ ʰ _h ʱ _hh ʲ ' ʴ ` ʷ _w ʼ _> ˈ \" ˌ % ː : ˑ :\\ ˠ _G ˡ _l ˤ _?\\ ˥ _T ˦ _H ˧ _M "
    "˨ _L ˩ _B ̂ _F ̃ ~ ̆ _X ̈ _\" ̌ _R ̘ _A ̙ _q ̚ _} ̜ _c ̝ _r ̞ _o ̟ _+ ̠ _- ̤ _t ̥ _0 ̩ = ̪ _d ̬ _v ̯ _^ ̰ _k ̴ _e ̹ _O ̺ _a ̻ _m ̼ _N ̽ _x ͜ _ ͡ _ β B "
    "θ T χ X ᶣ _H_w ᷄ _M_H ᷅ _L_M ᷆ _M_L ᷇ _H_M ᷈ _L_H_L ᷉ _H_L_H ‖ || ‿ -\\ ⁿ _n ↗ <R> ↘ <F> ␣ * ꜛ ^ ꜜ !"
)
KIRSHENBAUM = (
    "i i ɪ I e e ɛ E æ & a a ɑ A ʌ V ə @ ɨ i\" ɘ @<rnd> ɜ V\" ɐ &\" ɯ u- y y ʏ I. ø Y œ W ɶ &. u u ʊ U o o ɔ O ɒ A. ʉ u\" ɵ @. ɚ @<r> ɝ V\"<r> p p b b t t d d ʈ t. ɖ d. c c ɟ J k k ɡ g q q "
    "ɢ G ʔ ? m m ɱ m<lbd> n n ɳ n. ɲ n^ ŋ N ɴ n\" ʙ b<trl> r r<trl> ʀ r\" ɾ * ɽ *. ɸ P β B f f v v θ T ð D s s z z ʃ S ʒ Z ʂ s. ʐ z. ç C ʝ C<vcd> x x ɣ Q χ X ʁ g\" ħ H ʕ H<vcd> h h ɦ h<vcd> "
    "ɬ s<lat> ɮ z<lat> ʋ v<lbd> ɹ r ɻ r. j j ɰ j<vel> w w ʍ w<vls> l l ɭ l. ʎ l^ ʟ L t͡ʃ tS d͡ʒ dZ t͡s ts d͡z dz ɓ b` ɗ d` ʄ J` ɠ g` ʛ G` ʘ p! ǀ t! ǃ c! ǂ c!! ǁ l! pʰ p[h] tʰ t[h] kʰ k[h] m̩ m= n̩ n= l̩ l= ɹ̩ r= ː : ˈ ' ˌ , ̃ ~"
)


@cache
def table(name: str) -> dict[str, str]:
    """IPA to target; the first correspondence of an IPA symbol counts."""
    parts = {"cmu": CMU, "cmu+": f"{CMU} {CMU_EXTRAS}", "timit": TIMIT, "xsampa": XSAMPA, "kirshenbaum": KIRSHENBAUM}[name].split()
    out: dict[str, str] = {}
    for ipa, target in zip(parts[::2], parts[1::2], strict=True):
        out.setdefault(ipa, target)
    return out


@cache
def inverse(name: str) -> dict[str, str]:
    """Target to IPA; the first correspondence of a target counts, in X-SAMPA the last (of the ties, that of simultaneous parts)."""
    out: dict[str, str] = {}
    parts = f"{TIMIT} {TIMIT_READ}".split() if name == "timit" else [x for p in table(name).items() for x in p]
    for ipa, target in zip(parts[::2], parts[1::2], strict=True):
        if name == "xsampa":
            out[target] = ipa
        out.setdefault(target, ipa)
    if name == "cmu":
        out["AX"] = "ə"
    return out


def _alternation(keys) -> str:
    return "|".join(re.escape(k) for k in sorted(keys, key=lambda k: (-len(k), k)))


def _lookup(m: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), key)


def _runs(m: dict[str, str]) -> str:
    """A class of the symbols that stand for themselves and begin no longer key: whole runs of them need no lookup."""
    return "".join(re.escape(k) for k, v in m.items() if k == v and len(k) == 1 and not any(o != k and o.startswith(k) for o in m))


def convert_greedy(form: Column, m: dict[str, str]) -> Column:
    """Array of targets by longest match; what matches nothing is left out here and reported by unconvertible."""
    return F.transform(F.regexp_extract_all(form, F.lit(f"({_alternation(m)})"), 1), lambda k: _lookup(m, k))


def unconvertible(form: Column, m: dict[str, str]) -> Column:
    """Characters that a conversion can't carry, in their order, repeats included."""
    return F.filter(F.split(F.regexp_replace(form, _alternation(m), ""), ""), lambda c: c != "")


def _converted(form: Column, m: dict[str, str]) -> Column:
    """The joined targets of the longest matches."""
    runs = _runs(m)
    pattern = (f"[{runs}]+|" if runs else "") + _alternation([k for k in m if k not in runs or len(k) > 1])
    return F.array_join(F.transform(F.regexp_extract_all(form, F.lit(f"({pattern})"), 1), lambda k: F.coalesce(_lookup({a: b for a, b in m.items() if a != b}, k), k)), "")


def _strictly(form: Column, value: Column, lost: Column, what: str, strict: bool) -> Column:
    if not strict:
        return value
    return F.when(F.size(lost) > 0, F.raise_error(F.concat(F.lit(f"{what} can't carry "), F.array_join(F.array_sort(F.array_distinct(lost)), " ")))).otherwise(value)


def resolve_aliases(form: Column) -> Column:
    """Ligatures as the symbols that the tables know."""
    return X.expand_ligatures(form)


def _tied_as(bare: str, key: str):
    return lambda f: F.when(f.contains(bare) & ~f.contains(key), F.replace(f, F.lit(bare), F.lit(key))).otherwise(f)


def with_ties(form: Column, name: str) -> Column:
    """Ties put in where a table has a sequence only with one and the form has it only without: oʊ as o͜ʊ."""
    for key in table(name):
        bare = key.replace(I.TIE, "").replace(I.SEQUENCE, "")
        if bare != key:
            form = A.let(form, _tied_as(bare, key))
    return form


def house_ties(form: Column) -> Column:
    """A form whose ties are all simultaneous with those of sequences as the inventory writes them: its own symbols, and pairs of vowels."""
    for s in I.phones():
        if I.SEQUENCE in s:
            form = F.replace(form, F.lit(s.replace(I.SEQUENCE, I.TIE)), F.lit(s))
    vowels = "".join(s for s, b in I.stated().items() if len(s) == 1 and b["manner"] == "vowel")
    return F.regexp_replace(form, f"(?<=[{vowels}])({X.AFTER_CLASS}*){I.TIE}(?=[{vowels}])", f"$1{I.SEQUENCE}")


def _source(form: Column, name: str) -> Column:
    own = resolve_aliases(form)
    return with_ties(own, name) if name in ("kirshenbaum", "timit") else own


def losses_to(form: Column, name: str) -> Column:
    """Characters of a form that a notation (xsampa, kirshenbaum, timit) can't carry."""
    return unconvertible(_source(form, name), table(name))


def losses_from(text: Column, name: str) -> Column:
    """Characters of a text in a notation (xsampa, kirshenbaum) that stand for nothing."""
    return unconvertible(text, inverse(name))


def to_xsampa(form: Column, strict: bool = False) -> Column:
    """X-SAMPA, which has one tie for both senses. What it can't carry is left out and given by losses_to; strict: raises an error instead."""
    return _strictly(form, _converted(_source(form, "xsampa"), table("xsampa")), losses_to(form, "xsampa"), "X-SAMPA", strict)


def from_xsampa(text: Column, strict: bool = False) -> Column:
    return _strictly(text, house_ties(_converted(text, inverse("xsampa"))), losses_from(text, "xsampa"), "IPA", strict)


def to_kirshenbaum(form: Column, strict: bool = False) -> Column:
    """ASCII-IPA. What it can't carry is left out and given by losses_to; strict: raises an error instead."""
    return _strictly(form, _converted(_source(form, "kirshenbaum"), table("kirshenbaum")), losses_to(form, "kirshenbaum"), "Kirshenbaum", strict)


def from_kirshenbaum(text: Column, strict: bool = False) -> Column:
    return _strictly(text, _converted(text, inverse("kirshenbaum")), losses_from(text, "kirshenbaum"), "IPA", strict)


def to_timit(form: Column, strict: bool = False) -> Column:
    return _strictly(form, convert_greedy(_source(form, "timit"), table("timit")), losses_to(form, "timit"), "TIMIT", strict)


def from_timit(symbols: Column) -> Column:
    return F.array_join(F.filter(F.transform(symbols, lambda s: _lookup(inverse("timit"), s)), lambda x: x.isNotNull()), "")


def to_cmu(form: Column, with_stress: bool = True) -> Column:
    """ARPABET symbols; the stress of a unit, or of a consonant before it, goes to the next vowel, whose default is 0."""
    m = table("cmu")
    vowels = {"AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW"}
    start = F.struct(F.lit("").alias("stress"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, u: Column) -> Column:
        stress = F.when(u.contains("ˈ"), "1").when(u.contains("ˌ"), "2").otherwise(a["stress"])
        symbol = _lookup(m, X.bare(u))
        vowel = symbol.isin(*vowels)
        # the two readings of AH and ER that carry stress by their vowel keep a stress of their own if none is written
        shown = F.when(vowel & F.lit(with_stress), F.concat(symbol, F.when(stress == "", F.when(X.bare(u).isin("ʌ", "ɝ"), "1").otherwise("0")).otherwise(stress))).otherwise(symbol)
        return F.struct(F.when(vowel, F.lit("")).otherwise(stress).alias("stress"), F.array_append(a["out"], shown).alias("out"))

    return F.filter(F.aggregate(X.units(form), start, step, lambda a: a["out"]), lambda s: s.isNotNull())


def from_cmu(symbols: Column) -> Column:
    """IPA of ARPABET symbols, with stress marks before their vowels."""
    m = inverse("cmu")

    def one(s: Column) -> Column:
        base, level = F.regexp_extract(s, r"^([A-Z]+)([012]?)$", 1), F.regexp_extract(s, r"^([A-Z]+)([012]?)$", 2)
        ipa = F.when((base == "AH") & (level == "0"), "ə").when((base == "ER") & (level == "0"), "ɚ").when(base == "ER", "ɝ").otherwise(_lookup(m, base))
        return F.concat(F.when(level == "1", "ˈ").when(level == "2", "ˌ").otherwise(""), ipa)

    return F.array_join(F.filter(F.transform(symbols, one), lambda x: x.isNotNull()), "")


def vocabulary_tokenize(form: Column, atoms: list[str]) -> Column:
    """(atoms, residue): longest matches of a vocabulary of one's own, and what is left over."""
    alternation = _alternation(atoms)
    return F.struct(F.regexp_extract_all(form, F.lit(f"({alternation})"), 1).alias("atoms"), F.regexp_replace(form, f"{alternation}|\\s", "").alias("residue"))


def vocabulary_map(form: Column, targets: dict[str, str], drop: tuple[str, ...] = ()) -> Column:
    """(symbols, refused) under a vocabulary of one's own (atom: target): the targets of the longest matches, without those of atoms
    to drop, and the characters that no atom has."""
    own = targets | dict.fromkeys(drop, "")
    found = F.filter(convert_greedy(form, own), lambda s: s != "")
    return F.struct(found.alias("symbols"), F.filter(unconvertible(form, own), lambda c: c != " ").alias("refused"))


def vocabulary_read(symbols: Column, targets: dict[str, str]) -> Column:
    """(form, refused) of an array of a vocabulary's symbols; of several atoms with one target the first counts."""
    back: dict[str, str] = {}
    for atom, target in targets.items():
        back.setdefault(target, atom)
    known = F.array(*map(F.lit, back))
    return F.struct(F.array_join(F.transform(F.filter(symbols, lambda s: F.array_contains(known, s)), lambda s: _lookup(back, s)), "").alias("form"), F.filter(symbols, lambda s: ~F.array_contains(known, s)).alias("refused"))


def losses(form: Column, name: str) -> Column:
    """Units that a notation has no symbol for, without their stress, length and tone."""
    own = F.array(*map(F.lit, table(name)))
    return F.array_distinct(F.filter(F.transform(X.units(form), X.bare), lambda u: ~F.array_contains(own, u)))


def features_from(symbol: str, name: str) -> dict[str, str] | None:
    """The bundle of a symbol of a notation; None if it has none."""
    base = symbol.rstrip("012") if name == "cmu" else symbol
    unit = inverse(name).get(base)
    return None if unit is None else I.bundle_of(unit)
