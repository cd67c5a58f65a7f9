"""Structural queries ``X / L _ R`` and rewrite rules ``X -> Y / L _ R ; name``: their notation.

``automaton`` finds their sites, all in one pass over the form as it was. A variable over feature values is expanded over
the values, as these are few. ``<syllable`` and ``syllable>`` in a context stand for a place where an interval of a tier starts or ends.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, replace

from .. import inventory as I
from ..functions import text as X
from .terms import Query, QueryError, parse, symbols

NULLS = "∅0Ø"
ARROW = re.compile(r"\s*(~->|~=>|~→|~>|->|=>|→)\s*")
TIERS = ("mora", "syllable", "foot", "word", "phrase", "utterance")


@dataclass(frozen=True)
class Item:
    kind: str  # literal, bundle, any, boundary, null, tier
    value: str
    low: int = 1
    high: int | None = 1  # None: any number
    edge: str = ""  # of a tier: start or end


@dataclass(frozen=True)
class Pattern:
    target: Item
    left: tuple[Item, ...]
    right: tuple[Item, ...]


@dataclass(frozen=True)
class Rule:
    pattern: Pattern
    change: Item
    name: str
    source: str
    optional: bool


_TOKEN = re.compile(r"\s*(\[[^\]]*\]|<[\w-]+>?|[a-z][\w-]*>|\(|\)|[?*+]|\{\d*,?\d*\}|[.#%‿|‖]|" + X.unit_pattern() + r"|[∅0Ø])")


def _items(side: str) -> tuple[Item, ...]:
    out, at, open_ = [], 0, None
    while at < len(side.rstrip()):
        m = _TOKEN.match(side, at)
        if not m:
            raise QueryError(f"can't read {side[at:]!r} at {at}")
        at, t = m.end(), m[1]
        if t == "(":
            if open_ is not None:
                raise QueryError(f"nested parentheses at {m.start()}")
            open_ = len(out)
        elif t == ")":
            if open_ is None or len(out) != open_ + 1:
                raise QueryError(f"one item must stand in parentheses, at {m.start()}")
            q = re.match(r"[?*+]|\{(\d*)(,?)(\d*)\}", side[at:])
            low, high = 0, 1
            if q:
                at += q.end()
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(q[0]) or (int(q[1] or 0), int(q[3]) if q[3] else (None if q[2] else int(q[1])))
                if high is not None and high < low:
                    raise QueryError(f"a span of {low} to {high}, at {m.start()}")
            out[-1] = replace(out[-1], low=low, high=high)
            open_ = None
        elif t in "?+" or t[0] == "{":
            raise QueryError(f"a quantifier needs parentheses, at {m.start()}")
        else:
            out.append(_item(t))
    if open_ is not None:
        raise QueryError("a parenthesis isn't closed")
    return tuple(out)


def _item(t: str) -> Item:
    if t[0] == "[":
        return Item("bundle", t[1:-1].strip())
    if t[0] == "<" or t[-1] == ">":
        name = t.strip("<>")
        if name not in TIERS:
            raise QueryError(f"no tier {name!r}; there are {', '.join(TIERS)}")
        if t[0] == "<" and t[-1] == ">":
            raise QueryError(f"a tier term names an edge, <{name} or {name}>, not {t}")
        return Item("tier", name, edge="start" if t[0] == "<" else "end")
    if t == "*":
        return Item("any", "")
    if t in ".#%‿|‖":
        return Item("boundary", t)
    return Item("null", "") if t in NULLS else Item("literal", t)


def parse_query(spec: str) -> Pattern:
    """``X`` or ``X / L _ R``."""
    target, slash, context = spec.partition("/")
    items = _items(target)
    if len(items) != 1 or items[0].low != 1:
        raise QueryError(f"a query has one target: {target.strip()!r}")
    left, right = (), ()
    if slash:
        if context.count("_") != 1:
            raise QueryError("a context has exactly one _")
        left, right = (_items(s) for s in context.split("_"))
    if any(x.kind == "null" for x in (*left, *right)):
        raise QueryError("a context can't hold a null")
    if items[0].kind == "tier":
        raise QueryError("a tier term stands in a context, not as a target")
    return Pattern(items[0], left, right)


def parse_rule(source: str) -> Rule:
    body, _, name = source.partition(";")
    parts = ARROW.split(body, maxsplit=1)
    if len(parts) != 3:
        raise QueryError(f"a rule needs an arrow: {source!r}")
    change, slash, context = parts[2].partition("/")
    target = parts[0].strip()
    pattern = parse_query(f"{target} / {context}" if slash else target)
    items = _items(change)
    if len(items) > 1 and all(x.kind == "literal" for x in items):
        items = (Item("literal", "".join(x.value for x in items)),)
    if len(items) != 1:
        raise QueryError(f"a rule has one change: {change.strip()!r}")
    return Rule(pattern, items[0], name.strip() or source.strip(), source.strip(), parts[1].startswith("~"))


def query_rule(spec: str, replacement: str) -> Rule:
    """The rule that puts replacement where a query matches."""
    parse_query(spec)
    target, slash, context = (x.strip() for x in spec.partition("/"))
    return parse_rule(f"{target} -> {replacement}" + (f" / {context}" if slash else ""))


def parse_rules(text: str) -> list[Rule]:
    """Rules of a text, one on a line; lines that start with # are comments unless they are rules about a boundary."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") and not re.match(r"#\s*(~?[-=]>|~?→|~>)", line):
            continue
        out.append(parse_rule(line))
    return out


# -- compilation ------------------------------------------------------------------------------------------------------


def variables(p: Pattern) -> dict[str, tuple[str, ...]]:
    """Variable: values of the feature that it ranges over."""
    out: dict[str, tuple[str, ...]] = {}
    for x in (p.target, *p.left, *p.right):
        if x.kind == "bundle":
            for f, (v, _) in parse(x.value).agree.items():
                out.setdefault(v, I.values()[f])
    return out


def bindings(p: Pattern) -> list[dict[str, str]]:
    own = variables(p)
    return [dict(zip(own, vs, strict=True)) for vs in itertools.product(*own.values())]


def bound(q: Query, values: dict[str, str]) -> Query:
    """A query with its variables replaced by values; a negated one takes the other value of two."""
    required = dict(q.required)
    for f, (v, same) in q.agree.items():
        value = values[v]
        if not same:
            other = [x for x in I.values()[f] if x != value]
            if len(other) != 1:
                raise QueryError(f"-{v} needs a feature of two values, not {f!r}")
            value = other[0]
        required[f] = value
    return Query(required, q.included, q.excluded)


#: Stands before a site while a form is rewritten.
MARK = "\uf8ff"


def segmental(q: Query) -> Query:
    """A query without its prosody, which units have and symbols don't."""
    keep = lambda d: {f: v for f, v in d.items() if f not in ("stress", "length", "tone")}
    return Query(keep(q.required), keep(q.included), keep(q.excluded))


def outputs(rule: Rule, values: dict[str, str]) -> dict[str, str]:
    """For a change of features: each symbol of the target and what it becomes; symbols without such a counterpart stay."""
    change = bound(parse(rule.change.value), values)
    target = rule.pattern.target
    sources = [target.value] if target.kind == "literal" else symbols(segmental(bound(parse(target.value), values)) if target.kind == "bundle" else Query())
    out = {}
    by_bundle = {tuple(sorted(b.items())): s for s, b in reversed(I.full().items())}
    for s in sources:
        if s not in I.full() or s == I.SILENCE:
            continue
        wanted = tuple(sorted((I.full()[s] | change.required).items()))
        found = by_bundle.get(wanted)
        if found is None:
            marks = [m for f, v in change.required.items() for m, d in I.DIACRITICS.items() if d == {f: v} and I.full()[s].get(f) != v]
            marks += [m for m, fv in I.PROSODY.items() if change.required.get(fv[0]) == fv[1] and m not in I.STRESS_MARKS][:1]
            found = s + "".join(dict.fromkeys(marks)) if marks and len(marks) >= sum(I.full()[s].get(f) != v for f, v in change.required.items()) else None
        if found and found != s:
            out[s] = found
    return out
