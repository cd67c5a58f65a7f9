"""Vocabularies with aliases and reductions, composed into one table before anything is converted.

A vocabulary says how its atoms are written; aliases are other spellings of atoms, of aliases even; reductions say which atoms
a smaller set writes as others, or not at all. All of it is small and is closed on the driver, so that a conversion is one
longest match and one lookup, whatever the number of steps between.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import notation as N


class VocabularyError(ValueError):
    """A vocabulary that leads in a circle or nowhere."""


def closure(pointers: dict[str, str], ends: set[str], what: str) -> dict[str, str]:
    """Where each pointer leads in the end; refuses circles, and ends that aren't known."""
    out = {}
    for start in pointers:
        seen, at = [start], pointers[start]
        while at in pointers and at not in ends:
            if at in seen:
                raise VocabularyError(f"{what} {' -> '.join([*seen, at])} leads in a circle")
            seen.append(at)
            at = pointers[at]
        if at not in ends:
            raise VocabularyError(f"{what} {start!r} leads to {at!r}, which is no atom")
        out[start] = at
    return out


@dataclass(frozen=True)
class Vocabulary:
    """atoms: spelling and symbol; table: every spelling that is read, and the symbol that is written for it ("" for none)."""

    atoms: dict[str, str]
    table: dict[str, str]

    def map(self, form: Column) -> Column:
        """(symbols, refused) of a form."""
        found = F.filter(N.convert_greedy(form, self.table), lambda s: s != "")
        return F.struct(found.alias("symbols"), F.filter(N.unconvertible(form, self.table), lambda c: c != " ").alias("refused"))

    def read(self, symbols: Column) -> Column:
        """(form, refused) of an array of symbols: each as the atom whose own symbol it is, else the first that is written so."""
        own = sorted(self.atoms, key=lambda a: self.atoms[a] != self.table[a])
        return N.vocabulary_read(symbols, {a: self.table[a] for a in own if self.table[a] != ""})


def compose(atoms: dict[str, str], aliases: dict[str, str] | None = None, reductions: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> Vocabulary:
    """aliases: spelling to atom or to alias; reductions: atom to atom, step by step; drop: atoms that aren't written at all. An atom
    that reduces to a dropped one isn't either."""
    reductions = reductions or {}
    if strange := {*reductions, *drop} - set(atoms):
        raise VocabularyError(f"{', '.join(sorted(strange))}: no atom to reduce")
    stay = set(atoms) - set(reductions)
    reduced = {a: a for a in stay} | closure(reductions, stay, "reduction")
    written = {a: "" if reduced[a] in drop or a in drop else atoms[reduced[a]] for a in atoms}
    other = closure(aliases or {}, set(atoms), "alias")
    return Vocabulary(dict(atoms), {s: written[a] for s, a in other.items()} | written)
