"""Sites of patterns by classes: each token of a form becomes one character for what a pattern asks of it.

The contexts of a pattern are then regular expressions over these characters, one way over the string and one way over its
reverse, so that both sides are looked at ahead: no side has a bound, neither on spans nor on the marks of a unit. What is in
a unit is looked at once for each token, and for symbols without marks by a translation of the whole string.

A form is read in its encoded spelling (see text.encode). Positions are those of its tokens: units, boundaries, spaces, and
anything else character by character.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import inventory as I
from ..functions import algebra as A
from ..functions import text as X
from . import patterns as P
from .terms import Query, QueryError, parse, token_pattern

#: What stands in class strings: a left context ends, a site begins; then boundaries, spaces, and what can't be read.
ENDS, SITE = "\U000f0000", "\U000f0001"
_BOUNDARY = {b: chr(0xF0010 + k) for k, b in enumerate(I.BOUNDARIES)}
_SPACE, _OTHER = "\U000f0020", "\U000f0021"
#: Edges of intervals, two for each tier that a pattern names.
_EDGES = 0xF0030
_UNITS = 0xF1000
_MOST = 14
_PROSODIC = {"stress": "unstressed", "length": "normal", "tone": None}


class Classes:
    """What a pattern, under values of its variables, asks of single units."""

    def __init__(self, p: P.Pattern, values: dict[str, str], target: P.Item | None = None) -> None:
        self.asked: list[tuple[str, object]] = []
        self.values, self.pattern = values, p
        self.target = target or p.target
        self.tiers: dict[tuple[str, str], str] = {}
        for x in (self.target, *p.left, *p.right):
            if x.kind in ("literal", "base", "bundle", "any"):
                self._ask(x)
            elif x.kind == "tier":
                self.tiers.setdefault((x.value, x.edge), chr(_EDGES + len(self.tiers)))
        if len(self.asked) > _MOST:
            raise QueryError(f"a pattern asks for at most {_MOST} different kinds of units, not {len(self.asked)}")

    def _key(self, x: P.Item) -> tuple[str, object]:
        if x.kind in ("literal", "base"):
            return x.kind, x.value
        q = P.bound(parse(x.value), self.values) if x.kind == "bundle" else Query()
        return "bundle", (tuple(sorted(q.required.items())), tuple(sorted(q.included.items())), tuple(sorted(q.excluded.items())))

    def _ask(self, x: P.Item) -> int:
        key = self._key(x)
        if key not in self.asked:
            self.asked.append(key)
        return self.asked.index(key)

    # -- of symbols, on the driver

    def mask(self, symbol: str) -> int:
        bundle = I.full()[symbol]
        own = bundle | {f: v for f, v in _PROSODIC.items() if f == "stress"}
        holds = lambda kind, what: symbol == what if kind != "bundle" else _query(what).holds(own)
        return sum(1 << k for k, (kind, what) in enumerate(self.asked) if holds(kind, what))

    def symbols(self) -> tuple[str, str]:
        """Encoded symbols and boundaries, and the class of each."""
        code = X.compounds()
        pairs = [(code.get(s, s), chr(_UNITS + self.mask(s))) for s in I.phones()] + list(_BOUNDARY.items())
        return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)

    # -- of written units

    def _one_part(self, token: Column, kind: str, what) -> Column:
        if kind == "literal":
            return token.rlike(literal_pattern(what))
        if kind == "base":
            return token.rlike(f"^{X.STRESS_CLASS}*{P.re.escape(X.compounds().get(what, what))}{X.AFTER_CLASS}*$")
        return token.rlike(token_pattern(_query(what)))

    def _tied(self, token: Column, flat: Column, kind: str, what) -> Column:
        """Of a unit of several parts, whose flat bundle is given. Of marks for a prosodic feature the last counts."""
        if kind == "base":
            return F.lit(False)
        if kind == "literal":
            return token.rlike(literal_pattern(what))
        q = _query(what)
        keep = lambda d, prosodic: {f: v for f, v in d.items() if (f in _PROSODIC) == prosodic}
        own, prosody = (Query(keep(q.required, k), keep(q.included, k), keep(q.excluded, k)) for k in (False, True))
        at = lambda f: F.try_element_at(flat, F.lit(f))
        tests = [at(f).eqNullSafe(v) for f, v in own.required.items()] + [F.coalesce(at(f).isin(*vs), F.lit(False)) for f, vs in own.included.items()] + [~F.coalesce(at(f).isin(*vs), F.lit(False)) for f, vs in own.excluded.items()]
        if prosody.features():
            tests.append(token.rlike(token_pattern(prosody, bases=False)))
        return reduce(lambda x, y: x & y, tests, flat.isNotNull())

    def of_unit(self, token: Column, flat: Column) -> Column:
        if not self.asked:
            return F.lit(chr(_UNITS))
        table = F.lit("".join(chr(_UNITS + m) for m in range(1 << len(self.asked))))
        place = lambda held: F.substring(table, sum((F.when(held(*x), 1 << k).otherwise(0) for k, x in enumerate(self.asked)), F.lit(1)), F.lit(1))
        return F.when(flat.isNotNull(), place(lambda *x: self._tied(token, flat, *x))).otherwise(place(lambda *x: self._one_part(token, *x)))

    def of_token(self, x: Column) -> Column:
        token, (own, classes) = x["t"], self.symbols()
        single = F.translate(token, own, classes)
        other = F.when(token.rlike(r"^\s$"), _SPACE).when(token.rlike(f"^{X.STRESS_CLASS}*{X.base_class()}"), self.of_unit(token, x["flat"])).otherwise(_OTHER)
        return F.when((F.length(token) == 1) & (single != token), single).otherwise(other)

    # -- regular expressions over classes

    def _units_with(self, bit: int) -> str:
        masks = {self.mask(s) for s in I.phones()} if X.is_plain() else range(1 << len(self.asked))
        return "".join(chr(_UNITS + m) for m in sorted(masks) if m >> bit & 1)

    def item(self, x: P.Item) -> str:
        if x.kind == "boundary":
            own = strong(x.value)
            return f"[{_classes(own)}]" if x.value in "‿|‖" else f"(?:[{_classes(own)}{_SPACE}]|$)"
        found = self._units_with(self.asked.index(self._key(x)))
        return f"[{found}]" if found else "(?!)"

    def side(self, items: tuple[P.Item, ...]) -> str:
        """What follows a place, the items from near to far. Syllable marks may stand before any item."""
        other = f"{ENDS}{''.join(self.tiers.values())}"
        dots = f"(?:[{other}]*{_BOUNDARY['.']})*"
        out = []
        for x in items:
            if x.kind == "tier":
                out.append(f"(?=[{other}]*{self.tiers[x.value, x.edge]})")
                continue
            own = self.item(x)
            # an item that is left out leaves the marks before it, too
            one = f"(?:{dots}[{other}]*{own})"
            if (x.low, x.high) == (1, 1):
                out.append(one)
            elif x.high is None and own[0] == "[":
                # a class is repeated without recursion, however long the span
                out.append(f"{one * x.low if x.low < 4 else f'{one}{{{x.low}}}'}[{own[1:-1]}{other}{_BOUNDARY['.']}]*")
            else:
                high = "" if x.high is None else x.high
                long = f"{own}{{{x.low},{high}}}|" if own[0] == "[" and (x.high or 0) > 32 else ""
                out.append(f"(?:{long}{one}{{{x.low},{high}}})")
        return "".join(out)


def _query(key) -> Query:
    return Query(dict(key[0]), dict(key[1]), dict(key[2]))


def literal_pattern(unit: str) -> str:
    """A token that is the unit whatever its prosody; prosody that is written counts."""
    code = unit
    for s, c in X.compounds().items():
        code = code.replace(s, c)
    marks = "".join(m for m in I.PROSODY if m not in I.STRESS_MARKS)
    head = "" if unit[0] in I.STRESS_MARKS else f"{X.STRESS_CLASS}*"
    return f"^{head}{P.re.escape(code)}[{marks}]*$"


def strong(mark: str) -> str:
    """Boundaries at least as strong as a mark; a named one other than . # % is exact."""
    return mark if mark in "‿|‖" else {"%": ".#‿|‖", ".": ".#‿|‖", "#": "#‿|‖"}[mark]


def _classes(boundaries: str) -> str:
    return "".join(_BOUNDARY[b] for b in boundaries)


# -- forms -----------------------------------------------------------------------------------------------------------


def tokens_of(encoded: Column) -> Column:
    """All tokens of an encoded form: (t, flat), with the flat bundle of units of several parts. While text.plain holds, every
    character is one, and the form itself serves."""
    if X.is_plain():
        return encoded
    flat = lambda t: F.when(t.rlike(f"[{I.TIE}{I.SEQUENCE}]"), A.let(A.structure(X.decode(t)), lambda s: A.scalar(s)))
    return F.transform(F.regexp_extract_all(encoded, F.lit(rf"({X.unit_pattern()}|[\s\S])"), 1), lambda t: F.struct(t.alias("t"), flat(t).alias("flat")))


def joined(tokens: Column, at: Column, n: Column) -> Column:
    """Tokens at .. at + n - 1, together."""
    if X.is_plain():
        return F.substring(tokens, at + 1, n)
    return whole(F.slice(tokens, at + 1, n))


def whole(tokens: Column) -> Column:
    """The encoded form of its tokens."""
    return tokens if X.is_plain() else F.array_join(F.transform(tokens, lambda x: x["t"]), "")


@cache
def _known() -> str:
    return X.base_class()[1:-1] + "".join(I.BOUNDARIES)


def class_string(tokens: Column, c: Classes) -> Column:
    if X.is_plain():
        own, classes = c.symbols()
        return F.translate(F.regexp_replace(F.regexp_replace(tokens, r"\s", _SPACE), f"(?!{X.letters()})[^{_known()}{_SPACE}]", _OTHER), own, classes)
    return F.array_join(F.transform(tokens, c.of_token), "")


def _edged(tokens: Column, classes: Column, c: Classes, tiers: Column) -> Column:
    """A class string with the edges of intervals (tier, start, end: numbers of units) before and after the units they belong to."""
    each = F.split(classes, "")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("out"))

    def mark(edge: str, at: Column) -> Column:
        stands = lambda tier: F.exists(tiers, lambda t: (t["tier"] == tier) & (t[edge] == at))
        return F.concat(F.lit(""), *(F.when(stands(tier), m).otherwise("") for (tier, e), m in c.tiers.items() if e == edge))

    def step(a: Column, x: Column) -> Column:
        unit = F.struct((a["n"] + 1).alias("n"), F.concat(a["out"], mark("start", a["n"]), x, mark("end", a["n"] + 1)).alias("out"))
        return F.when(x >= F.lit(chr(_UNITS)), unit).otherwise(F.struct(a["n"].alias("n"), F.concat(a["out"], x).alias("out")))

    return F.aggregate(F.filter(each, lambda x: x != ""), start, step, lambda a: a["out"])


def _after_span(c: Classes) -> str | None:
    """For targets after a unit and an open span that can't hold that unit, but can hold targets: one pass over the form, in which a
    match begins at the unit or where the last one ended, so that no target looks back over the whole span."""
    p = c.pattern
    if len(p.left) != 2 or any(x.kind not in ("literal", "base", "bundle", "any") for x in (*p.left, c.target)):
        return None
    first, span = p.left
    if (first.low, first.high) != (1, 1) or span.high is not None:
        return None
    one, many, own = (set(c.item(x)[1:-1]) if c.item(x)[0] == "[" else set() for x in (first, span, c.target))
    if not one or not own or one & many or not own <= many:
        return None
    marks = ENDS + _BOUNDARY["."]
    least = f"(?:[{marks}]*+{c.item(span)}){{{span.low}}}" if span.low else ""
    return f"({c.item(first)}{least}|\\G(?!^))([{''.join(sorted(many - own))}{marks}]*+)({c.item(c.target)})"


def sites_in(tokens: Column, c: Classes, tiers: Column | None = None) -> Column:
    """The class string of a form with SITE before each place where the pattern holds, and nothing else added. A boundary as target
    is the whole run of marks that it matches, and SITE stands before its first."""
    p, edges = c.pattern, "".join(c.tiers.values())
    s = class_string(tokens, c)
    if c.tiers:
        if tiers is None:
            raise QueryError("a pattern that names a tier needs intervals")
        s = _edged(tokens, s, c, tiers)
    left, right = c.side(tuple(reversed(p.left))), c.side(p.right)
    after = None if edges else _after_span(c)
    if after:
        s = F.regexp_replace(s, after, f"$1$2{ENDS}$3")
    elif p.left:
        # looked for only next to a target, where nothing can stand between
        near = "" if edges or c.target.kind in ("null", "boundary") else f"(?<={c.item(c.target)})"
        s = F.reverse(F.regexp_replace(F.reverse(s), f"{near}(?={left})", ENDS))
        if edges:  # once among the edges of a place, and after them
            s = F.regexp_replace(s, f"{ENDS}(?=[{edges}{ENDS}]*{ENDS})", "")
            s = F.regexp_replace(s, f"{ENDS}([{edges}]+)", f"$1{ENDS}")
    lead = ENDS if p.left else ""
    if p.left and edges and c.target.kind not in ("null", "boundary"):
        s = F.regexp_replace(s, f"{ENDS}(?!{c.item(c.target)})", "")
    if c.target.kind == "null":
        s = F.regexp_replace(s, f"{lead}(?={right})", SITE)
    elif c.target.kind == "boundary":
        own = _classes(strong(c.target.value))
        s = F.regexp_replace(s, f"(?<![{own}]){lead}(?=[{own}](?:[{ENDS}{edges}]*[{own}])*+{right})", SITE)
    else:
        s = F.regexp_replace(s, f"{lead}(?={c.item(c.target)}{right})", SITE)
    if p.left or edges:
        s = F.regexp_replace(s, f"[{ENDS}{edges}]", "")
    return _anchored(s, p) if c.target.kind == "null" else s


def _anchored(s: Column, p: P.Pattern) -> Column:
    """Of the places around a run of boundaries one for an insertion: inside at an edge of the form, else the first; where the left
    context names a boundary, the last, too."""
    marks = _classes("".join(I.BOUNDARIES))
    s = F.regexp_replace(s, f"{SITE}+", SITE)
    ends, run = f"[{marks}{SITE}]*", f"[{marks}]"
    named = bool(p.left) and p.left[-1].kind == "boundary"

    def parts(x: Column) -> Column:
        head = F.regexp_extract(x, f"^({ends})", 1)
        rest = F.substring(x, F.length(head) + 1, F.length(x))
        tail = F.reverse(F.regexp_extract(F.reverse(rest), f"^({ends})", 1))
        inner = F.substring(rest, F.lit(1), F.length(rest) - F.length(tail))
        bare_head, bare_tail = F.replace(head, F.lit(SITE), F.lit("")), F.replace(tail, F.lit(SITE), F.lit(""))
        inner = F.regexp_replace(inner, f"(?<={run}){SITE}" + (f"(?={run})" if named else ""), "")
        return F.concat(bare_head, F.when(head.endswith(SITE), SITE).otherwise(""), inner, F.when(tail.startswith(SITE), SITE).otherwise(""), bare_tail)

    return A.let(s, lambda x: F.when(x.rlike(run), parts(x)).otherwise(x))


def places(marked: Column) -> Column:
    """(at, units): tokens and units before each site of a marked class string, in one pass over it."""
    own = f"[^{chr(_UNITS)}-{chr(_UNITS + (1 << _MOST))}]"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("units"))
    none = F.array().cast("array<struct<at:int,units:bigint>>")

    def step(a: Column, x: Column) -> Column:
        here = F.struct((a["here"]["at"] + F.length(x)).alias("at"), (a["here"]["units"] + F.length(F.regexp_replace(x, own, ""))).alias("units"))
        return A.let(here, lambda h: F.struct(h.alias("here"), F.array_append(a["out"], h).alias("out")))

    return A.let(F.split(marked, SITE), lambda p: F.aggregate(F.slice(p, 1, F.size(p) - 1), F.struct(start.alias("here"), none.alias("out")), step, lambda a: a["out"]))


def count(marked: Column) -> Column:
    """How many sites a marked class string has."""
    return F.coalesce(F.length(marked) - F.length(F.replace(marked, F.lit(SITE), F.lit(""))), F.lit(0))


def bare(marked: Column) -> Column:
    return F.replace(marked, F.lit(SITE), F.lit(""))


def spliced(tokens: Column, marked: Column, mark: str) -> Column:
    """The form with a mark where the sites of its class string are."""

    def rebuilt(p: Column) -> Column:
        start = F.struct(F.length(p[0]).alias("n"), joined(tokens, F.lit(0), F.length(p[0])).alias("out"))
        step = lambda a, x: F.struct((a["n"] + F.length(x)).alias("n"), F.concat(a["out"], F.lit(mark), joined(tokens, a["n"], F.length(x))).alias("out"))
        return F.aggregate(F.slice(p, 2, F.size(p)), start, step, lambda a: a["out"])

    return F.when(marked.contains(SITE), A.let(F.split(marked, SITE), rebuilt)).otherwise(whole(tokens))
