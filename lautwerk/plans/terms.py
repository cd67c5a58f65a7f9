"""Feature queries: terms to constraints, constraints to symbols and to patterns.

A term is ``key=value``, ``+name``/``-name``/``0name``, a value that exactly one feature has, or a named class; ``-value``
and ``-class`` exclude. A required or included value fails on a unit without the feature; an exclusion holds there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .. import inventory as I
from ..functions import text as X


class QueryError(ValueError):
    """A query that can't be understood; the message says where."""


@dataclass
class Query:
    required: dict[str, str] = field(default_factory=dict)
    included: dict[str, tuple[str, ...]] = field(default_factory=dict)
    excluded: dict[str, tuple[str, ...]] = field(default_factory=dict)
    agree: dict[str, tuple[str, bool]] = field(default_factory=dict)  # feature: variable, same

    def holds(self, bundle: dict[str, str]) -> bool:
        return (
            all(bundle.get(f) == v for f, v in self.required.items())
            and all(bundle.get(f) in vs for f, vs in self.included.items())
            and all(bundle.get(f) not in vs for f, vs in self.excluded.items())
        )

    def features(self) -> set[str]:
        return {*self.required, *self.included, *self.excluded}


VARIABLES = "αβγδ"


#: Their values win as bare terms over those of other features.
BARE = ("manner", "place", "channel", "height", "backness")


def claimants(value: str) -> list[str]:
    own = [f for f, vs in I.values().items() if value in vs and value not in "+-0"]
    return [f for f in own if f in BARE] or own


def parse(terms: str | list[str]) -> Query:
    """Constraints of a list of terms, given as such or separated by commas or spaces."""
    out = Query()
    for term in re.split(r"[,\s]+", terms.strip()) if isinstance(terms, str) else terms:
        if not term:
            continue
        if "=" in term:
            f, v = term.split("=", 1)
            if f not in I.values():
                raise QueryError(f"no feature {f!r}")
            if v.lstrip("-") in VARIABLES and v.lstrip("-"):
                out.agree[f] = (v.lstrip("-"), not v.startswith("-"))
            elif v not in I.values()[f]:
                raise QueryError(f"{f!r} has no value {v!r}")
            else:
                _require(out, f, v)
            continue
        sign, name = (term[0], term[1:]) if term[0] in "+-0" and len(term) > 1 else ("+", term)
        if name in I.CLASSES:
            f, vs = I.CLASSES[name]
            (out.included if sign == "+" else out.excluded)[f] = vs
        elif name in I.values() and sign in I.values()[name]:
            _require(out, name, sign)
        else:
            own = claimants(name)
            if len(own) != 1:
                raise QueryError(f"{name!r} " + (f"could be of {', '.join(own)}" if own else "is no feature, value or class"))
            if sign == "+":
                _require(out, own[0], name)
            else:
                out.excluded[own[0]] = (*out.excluded.get(own[0], ()), name)
    return out


def _require(q: Query, f: str, v: str) -> None:
    if q.required.get(f, v) != v:
        raise QueryError(f"{f!r} can't be both {q.required[f]!r} and {v!r}")
    q.required[f] = v


def symbols(q: Query) -> list[str]:
    """Inventory symbols that satisfy a query, in declared order."""
    return [s for s, b in I.full().items() if q.holds(b)]


def token_pattern(q: Query, bases: bool = True) -> str:
    """A pattern for a whole encoded unit of one part that satisfies a query. Of several marks for a feature the last one counts, so
    each constraint looks at the last mark that touches it, or at the base if none does. bases: False for a unit of several
    parts, of which only marks are looked at, each without one counting as the value that units have unmarked."""
    code = {s: X.compounds().get(s, s) for s in I.phones()}
    chars = lambda ss: "[" + "".join(code[s] for s in ss) + "]" if ss else "(?!)"
    any_base = chars(list(I.phones()))
    marks = X.AFTER_CLASS[1:-1]
    body = f"{any_base}[{marks}]*" if bases else r"[\s\S]*"
    looks = []
    for f in sorted(q.features()):
        own = Query({f: q.required[f]} if f in q.required else {}, {f: q.included[f]} if f in q.included else {}, {f: q.excluded[f]} if f in q.excluded else {})
        touch = {m: d[f] for m, d in I.DIACRITICS.items() if f in d} | {m: v for m, (g, v) in I.PROSODY.items() if g == f and m not in I.STRESS_MARKS}
        if f == "stress":
            # of several marks the last counts, as for other prosody
            good = "".join(m for m in I.STRESS_MARKS if own.holds({f: I.PROSODY[m][1]}))
            ways = [f"{X.STRESS_CLASS}*[{good}](?!{X.STRESS_CLASS})"] * bool(good) + [f"(?!{X.STRESS_CLASS})"] * own.holds({f: "unstressed"})
            looks.append(f"(?={'|'.join(ways) or '(?!)'})")
            continue
        good = "".join(m for m, v in touch.items() if own.holds({f: v}))
        every = "".join(touch)
        head = f"{X.STRESS_CLASS}*"
        quiet = f"[^{every}]*$" if every else ""
        if bases:
            ways = [f"{head}{chars([s for s, b in I.full().items() if own.holds(b)])}{quiet}"]
        else:
            ways = [f"{head}{quiet or '.'}"] if own.holds({"length": "normal"} if f == "length" else {}) else []
        if good:
            ways.append(f"{head}{body}[{good}]{quiet}")
        looks.append(f"(?={'|'.join(ways) or '(?!)'})")
    return f"^{''.join(looks)}{X.STRESS_CLASS}*{body}$"
