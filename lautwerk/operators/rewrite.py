"""Ordered rewriting: rules, cascades with their trace, optional rules and derivability.

A rule finds all its sites in the form as it was and marks them (see automaton); then what is marked is written anew. Cascades are chains of expressions; no rows move.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import inventory as I
from ..functions import algebra as A
from ..functions import text as X
from ..plans import automaton as T
from ..plans import patterns as P
from ..plans.terms import Query, parse, symbols


def _code(unit: str) -> str:
    for s, c in X.compounds().items():
        unit = unit.replace(s, c)
    return unit


#: A site whose choice is open: OPEN old TO new DONE.
OPEN, TO, DONE = "\ue0f1", "\ue0f2", "\ue0f3"


def apply_rule(encoded: Column, rule: P.Rule) -> Column:
    """One rule on an encoded form."""
    return _cascade(encoded, [rule])


def _steps(rules: list[P.Rule]) -> list[tuple[P.Rule, dict[str, str]]]:
    """Rules one after another, each under all values of its variables."""
    return [(r, values) for r in rules for values in P.bindings(r.pattern)]


def _step(form: Column, k: Column, steps: list[tuple[P.Rule, dict[str, str]]]) -> Column:
    """Step number k; the tokens of the form are read once for all."""

    def one(t: Column) -> Column:
        out = F.when(F.lit(False), form)
        for n, (rule, values) in enumerate(steps):
            out = out.when(k == n, _rewritten(t, form, rule, values))
        return out.otherwise(form)

    return A.let(T.tokens_of(form), one)


def _cascade(encoded: Column, rules: list[P.Rule]) -> Column:
    """Rules as the steps of a fold, so that the expression is no deeper for many than for one."""
    steps = _steps(rules)
    if len(steps) < 2:
        return reduce(lambda e, s: _apply(e, *s), steps, encoded)
    return F.when(encoded.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), encoded, lambda form, k: _step(form, k, steps)))


def _apply(e: Column, rule: P.Rule, values: dict[str, str], both: bool = False, tiers: Column | None = None) -> Column:
    """The form with all sites rewritten; both: with what stands at each and what it becomes."""
    return A.let(T.tokens_of(e), lambda t: _rewritten(t, T.whole(t), rule, values, both, tiers))


def _rewritten(t: Column, e: Column, rule: P.Rule, values: dict[str, str], both: bool = False, tiers: Column | None = None) -> Column:
    p = rule.pattern
    put = lambda old, new: f"{OPEN}{old}{TO}{new}{DONE}" if both else new
    change, target = rule.change, p.target
    whole = change.kind in ("null", "literal") and target.kind == "literal" and target.value not in I.full()  # a unit with marks of its own
    out: dict[str, str] = {}
    if change.kind == "literal" and target.kind in ("literal", "bundle", "any") and not whole:
        sources = [target.value] if target.kind == "literal" else symbols(P.segmental(P.bound(parse(target.value), values)) if target.kind == "bundle" else Query())
        out = {s: change.value for s in sources if s in I.full() and s != change.value}
    elif change.kind == "bundle":
        out = P.outputs(rule, values)
    replaced = change.kind != "null" and target.kind in ("literal", "bundle", "any") and not whole
    if replaced and not out:
        return e
    # a symbol as target of a change stands for units with marks, too
    own = P.Item("base", target.value) if replaced and target.kind == "literal" else target
    c = T.Classes(p, values, own)
    marked = A.let(T.sites_in(t, c, tiers), lambda m: T.spliced(t, m, P.MARK))
    if target.kind == "null":
        return F.replace(marked, F.lit(P.MARK), F.lit(put("", _code(change.value))))
    if target.kind == "boundary":  # a run of marks is one boundary
        return F.regexp_replace(marked, f"{P.MARK}([{re.escape(T.strong(target.value))}]+)", put("$1", _quoted("" if change.kind == "null" else change.value)))
    if change.kind == "null":
        return F.regexp_replace(marked, f"{P.MARK}({X.base_class() if X.is_plain() else X.unit_pattern()})", put("$1", ""))
    if not X.is_plain():
        # from before a unit to before its base; units of several parts stay
        marked = F.regexp_replace(marked, f"{P.MARK}({X.STRESS_CLASS}+)", f"$1{P.MARK}")
        marked = F.regexp_replace(marked, f"{P.MARK}(?={X.base_class()}{X.AFTER_CLASS}*[{I.TIE}{I.SEQUENCE}])", "") if not whole else marked
    if whole:
        out = {target.value.lstrip(I.STRESS_MARKS): change.value}

    def put_in(m: Column) -> Column:
        for s, o in out.items():
            m = F.replace(m, F.lit(P.MARK + _code(s)), F.lit(put(_code(s), _code(o))))
        return F.replace(m, F.lit(P.MARK), F.lit(""))

    # the form is named once, so that a cascade nests its expressions without copies; most forms have no site
    return A.let(marked, lambda m: F.when(m.contains(P.MARK), put_in(m)).otherwise(m))


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def rules_of(rules: str | list[P.Rule]) -> list[P.Rule]:
    return P.parse_rules(rules) if isinstance(rules, str) else rules


def rewrite(form: Column, rules: str | list[P.Rule], plain: bool = False) -> Column:
    """A form after an ordered cascade, optional rules included; null stays null. plain: no form has marks, nor gets any, see text.plain."""
    with X.plain(plain):
        return X.decode(_cascade(X.encode(form), rules_of(rules)))


def derive(df: DataFrame, form_col: str, rules: str | list[P.Rule], plain: bool = False) -> DataFrame:
    """df with surface and trace: (name, before, after) of each rule that changed something, in order."""
    own = rules_of(rules)
    steps = _steps(own)
    kind = "array<struct<name:string,before:string,after:string>>"
    none = F.array().cast(kind)
    if not steps:
        return df.select("*", F.col(form_col).alias("surface"), none.alias("trace"))
    first = F.array(*(F.lit(n == 0 or steps[n - 1][0] is not r) for n, (r, _) in enumerate(steps)))
    last = F.array(*(F.lit(n + 1 == len(steps) or steps[n + 1][0] is not r) for n, (r, _) in enumerate(steps)))
    names = F.array(*(F.lit(r.name) for r, _ in steps))

    def step(a: Column, k: Column) -> Column:
        before = F.when(F.get(first, k), a["form"]).otherwise(a["before"])

        def noted(new: Column) -> Column:
            entry = F.struct(F.get(names, k).alias("name"), X.decode(before).alias("before"), X.decode(new).alias("after"))
            return F.struct(new.alias("form"), before.alias("before"), F.when(F.get(last, k) & (new != before), F.array_append(a["trace"], entry)).otherwise(a["trace"]).alias("trace"))

        return A.let(_step(a["form"], k, steps), noted)

    with X.plain(plain):
        form = X.encode(F.col(form_col))
        state = F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.struct(form.alias("form"), form.alias("before"), none.alias("trace")), step)
    whole = X.free(df, "derivation")
    out = df.withColumn(whole, F.when(F.col(form_col).isNotNull(), state))
    return out.select(*df.columns, X.decode(F.col(whole)["form"]).alias("surface"), F.coalesce(F.col(whole)["trace"], none).alias("trace"))


def derivation_graph(df: DataFrame, id_col: str, form_col: str, rules: str | list[P.Rule]) -> DataFrame:
    """(graph, name, src, ordinal, tgt): the derivation of each form as relations from one stage to the next, named by the rule."""
    d = derive(df.select(F.col(id_col).cast("string").alias("graph"), F.col(form_col).alias("form")), "form", rules)
    steps = d.select("graph", F.posexplode("trace").alias("k", "s"))
    at = lambda k, form: F.concat(k.cast("string"), F.lit(":"), form)
    return steps.select("graph", F.col("s.name").alias("name"), at(F.col("k"), F.col("s.before")).alias("src"), F.lit(0).alias("ordinal"), at(F.col("k") + 1, F.col("s.after")).alias("tgt"))


def edits(form: Column, rule: str | P.Rule) -> Column:
    """(at, removed, added) of every site of a rule, in order: the number of units before it, and the units that go and come."""
    own = rules_of(rule)[0] if isinstance(rule, str) else rule
    each = [_edits(form, own, values) for values in P.bindings(own.pattern)]
    return F.array_sort(F.array_distinct(F.concat(*each)))


def _edits(form: Column, rule: P.Rule, values: dict[str, str]) -> Column:
    pieces = F.split(_apply(X.encode(form), rule, values, both=True), OPEN)
    n = lambda c: F.size(X.units(X.decode(c)))
    start = F.struct(n(F.get(pieces, 0)).alias("n"), F.array().cast("array<struct<at:int,removed:string,added:string>>").alias("out"))

    def step(a: Column, site: Column) -> Column:
        x = F.split(site, f"[{TO}{DONE}]")
        edit = F.struct(a["n"].alias("at"), X.decode(x[0]).alias("removed"), X.decode(x[1]).alias("added"))
        return F.struct((a["n"] + n(F.concat(x[0], x[2]))).alias("n"), F.array_append(a["out"], edit).alias("out"))

    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step, lambda a: a["out"])


def recognize(form: Column, rule: str | P.Rule) -> Column:
    """Places (units before) where a rule would apply, whether or not it would change something there."""
    return F.transform(edits(form, rule), lambda e: e["at"])


def unexplored(df: DataFrame, form_col: str, rules: str | list[P.Rule], limit: int = 64, plain: bool = False) -> DataFrame:
    """The rows of df of which the limit cuts variants."""
    v = variants(df, form_col, rules, limit, plain)
    return v.where(~F.col("complete")).select(*df.columns)


def variants(df: DataFrame, form_col: str, rules: str | list[P.Rule], limit: int = 64, plain: bool = False) -> DataFrame:
    """df with variants: forms that some choice of the sites of optional rules (each rewritten or not) leads to, with the
    fewest rewritten ones for each form, cheapest first; complete tells whether the limit cut any.

    The values of a variable are tried one after another, as in apply_rule, so each opens its own sites."""
    states = F.when(F.col(form_col).isNotNull(), F.array(F.struct(F.lit(0).alias("cost"), X.encode(F.col(form_col)).alias("form"))))
    own, whole = X.free(df, "__states"), X.free(df, "__complete")
    out = df.withColumn(own, F.coalesce(states, F.array().cast("array<struct<cost:int,form:string>>"))).withColumn(whole, F.lit(True))
    for r in rules_of(rules):
        with X.plain(plain):
            steps = [_choices(r, values, limit) for values in P.bindings(r.pattern)] if r.optional else [_always(r)]
            for step in steps:
                out = out.withColumn(own, _cheapest(F.flatten(F.transform(own, step)), limit + 1))
                out = out.withColumn(whole, F.col(whole) & (F.size(own) <= limit)).withColumn(own, F.slice(own, 1, limit))
    shown = F.transform(own, lambda s: F.struct(X.decode(s["form"]).alias("form"), s["cost"].alias("cost")))
    return out.select(*df.columns, F.when(F.col(form_col).isNotNull(), shown).alias("variants"), F.col(whole).alias("complete"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _cheapest(states: Column, most: int) -> Column:
    """The cheapest state of each form, at most so many, by cost."""

    def sorted_(a: Column) -> Column:
        by_form = F.array_sort(F.transform(a, lambda s: F.struct(s["form"].alias("form"), s["cost"].alias("cost"))))
        first = _let(by_form, lambda b: F.filter(b, lambda s, i: (i == 0) | (F.get(b, i - 1)["form"] != s["form"])))
        return F.slice(F.array_sort(F.transform(first, lambda s: F.struct(s["cost"].alias("cost"), s["form"].alias("form")))), 1, most)

    # most forms have one state, which is the cheapest
    return _let(states, lambda a: F.when(F.size(a) > 1, sorted_(a)).otherwise(F.slice(a, 1, most)))


def _always(rule: P.Rule) -> Callable[[Column], Column]:
    return lambda s: F.array(F.struct(s["cost"].alias("cost"), apply_rule(s["form"], rule).alias("form")))


def _choices(rule: P.Rule, values: dict[str, str], limit: int) -> Callable[[Column], Column]:
    """The states that every subset of the sites of a state leads to. Each site doubles the beginnings; one more than the
    limit stays, so the cut shows. A beginning costs no less when it goes on, so the cheapest are never cut."""

    def fork(s: Column) -> Column:
        start = lambda p: F.array(F.struct(s["cost"].alias("cost"), F.get(p, 0).alias("form")))
        forked = lambda p: F.aggregate(F.slice(p, 2, F.size(p)), start(p), lambda acc, site: _let(F.split(site, f"[{TO}{DONE}]"), lambda x: both(acc, x)))
        return _let(_apply(s["form"], rule, values, both=True), lambda f: F.when(f.contains(OPEN), forked(F.split(f, OPEN))).otherwise(F.array(F.struct(s["cost"].alias("cost"), f.alias("form")))))

    def both(acc: Column, x: Column) -> Column:
        kept = F.transform(acc, lambda s: F.struct(s["cost"].alias("cost"), F.concat(s["form"], x[0], x[2]).alias("form")))
        changed = F.transform(acc, lambda s: F.struct((s["cost"] + 1).alias("cost"), F.concat(s["form"], x[1], x[2]).alias("form")))
        return _cheapest(F.concat(kept, changed), limit + 1)

    return fork


def derives(df: DataFrame, source_col: str, target_col: str, rules: str | list[P.Rule], limit: int = 64) -> DataFrame:
    """df with verdict: witness (the target is a variant), refused (no variant is), or budget (some were cut)."""
    v = variants(df, source_col, rules, limit)
    hit = F.exists("variants", lambda s: s["form"] == F.col(target_col))
    return v.select(*df.columns, F.when(hit, "witness").when(F.col("complete"), "refused").otherwise("budget").alias("verdict"))


def invertibility(rules: str | list[P.Rule]) -> list[tuple[str, bool, bool]]:
    """(rule, keeps length, injective on the inventory) for each rule."""
    out = []
    for r in rules_of(rules):
        same = "null" not in (r.pattern.target.kind, r.change.kind)
        maps = P.outputs(r, b) if r.change.kind == "bundle" and (b := (P.bindings(r.pattern) or [{}])[0]) is not None else {s: r.change.value for s in (symbols(parse(r.pattern.target.value)) if r.pattern.target.kind == "bundle" else [r.pattern.target.value])}
        image = [maps.get(s, s) for s in I.phones()]
        out.append((r.name, same, len(set(image)) == len(image)))
    return out


def experiment(df: DataFrame, source_col: str, target_col: str, rules: str | list[P.Rule], limit: int = 64) -> DataFrame:
    """df with class: unchanged, derived, refused or budget."""
    v = derives(df, source_col, target_col, rules, limit)
    return v.withColumn("class", F.when(F.col(source_col) == F.col(target_col), "unchanged").when(F.col("verdict") == "witness", "derived").otherwise(F.col("verdict"))).drop("verdict")


def compare_experiments(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, was, now) of the rows whose class moved. Reports on different rows aren't comparable and are refused."""
    a, b = before.select(key, F.col("class").alias("was")), after.select(key, F.col("class").alias("now"))
    both = a.join(b, key, "full")
    if not both.where("was is null or now is null").isEmpty():
        raise ValueError("the reports are about different rows")
    return both.where("was <> now")


def regime(rules: str | list[P.Rule]) -> str:
    """Of a rule set: invertible, length-preserving, or lossy."""
    own = invertibility(rules)
    return "invertible" if all(same and one for _, same, one in own) else "length-preserving" if all(same for _, same, _ in own) else "lossy"


# Rule sets by language, in their published order and wording.
SHIPPED = {
    "german-final-devoicing": "[obstruent] -> [voiced=-] / _ . ; final devoicing",
    "french-liaison": """
∅ -> z / z ‿ _ [vowel] ; liaison (z)
∅ -> t / t ‿ _ [vowel] ; liaison (t)
∅ -> n / n ‿ _ [vowel] ; liaison (n)
∅ -> p / p ‿ _ [vowel] ; liaison (p)
z -> ∅ / _ # ; final z deletion
t -> ∅ / _ # ; final t deletion
n -> ∅ / _ # ; final n deletion
p -> ∅ / _ # ; final p deletion
ə -> ∅ / [vowel] [-vowel] _ # ; final schwa deletion
ə -> ∅ / [-vowel] [-vowel] _ # ; final schwa deletion (after a cluster)
ə ~> ∅ / # [-vowel] _ [-vowel] [vowel] ; e caduc (first syllable)
ə ~> ∅ / [vowel] [-vowel] _ [-vowel] [vowel] ; e caduc (interior)
""",
    "japanese-moraic": """
[manner=approximant place=alveolar] -> ɾ ; liquids are the tap
θ -> s ; θ is s
ð -> z ; ð is z
v -> b ; v is b
f -> ɸ ; f is ɸ
ʃ -> ɕ ; ʃ is the alveolo-palatal
t͡ʃ -> t͡ɕ ; t͡ʃ is the alveolo-palatal affricate
d͡ʒ -> d͡ʑ ; d͡ʒ is the voiced alveolo-palatal affricate
ŋ -> ŋɡ / _ # ; final ŋ takes a velar stop
i -> iː ; tense i lengthens
u -> uː ; tense u lengthens
ɔ -> oː ; ɔ is long o
e͜ɪ -> eː ; eɪ is long e
o͜ʊ -> oː ; oʊ is long o
ɚ -> aː ; unstressed r-colored vowel is long a
ɝ -> aː ; stressed r-colored vowel is long a
a͜ɪ -> ai ; aɪ is a + i
a͜ʊ -> au ; aʊ is a + u
ɔ͜ɪ -> oi ; ɔɪ is o + i
ɪ -> i ; ɪ is short i
ɛ -> e ; ɛ is short e
æ -> a ; æ is short a
ʌ -> a ; ʌ is short a
ə -> a ; ə is short a
ʊ -> u ; ʊ is short u
ɑ -> o ; ɑ is short o
[obstruent -fricative] -> [length=long] / [-vowel] [vowel -long] _ # ; gemination (after a consonant)
[obstruent -fricative] -> [length=long] / # [vowel -long] _ # ; gemination (word-initial vowel)
∅ -> o / [manner=plosive place=alveolar] _ [-vowel -approximant] ; o after a coronal stop (cluster)
∅ -> o / [manner=plosive place=alveolar] _ # ; o after a coronal stop (final)
∅ -> i / [manner=affricate place=alveolo-palatal] _ [-vowel -approximant] ; i after an alveolo-palatal affricate (cluster)
∅ -> i / [manner=affricate place=alveolo-palatal] _ # ; i after an alveolo-palatal affricate (final)
∅ -> u / [-vowel -nasal] _ [-vowel -approximant] ; u elsewhere (cluster)
∅ -> u / [-vowel -nasal] _ # ; u elsewhere (final)
∅ -> u / [manner=nasal place=bilabial] _ # ; u after a final labial nasal
""",
    "spanish-accented-english": """
∅ -> e / # _ s [-vowel -approximant] ; prothesis (s + obstruent or nasal)
∅ -> e / # _ s [channel=lateral] ; prothesis (s + l)
v -> b ; v is b
z -> s ; z is s
ʃ -> t͡ʃ ; ʃ is t͡ʃ
θ -> t ; θ is t
ð -> d ; ð is d
h -> x ; h is x
ŋ -> n / _ # ; final ŋ is n
ɚ -> eɹ ; unstressed r-colored vowel decomposes
ɝ -> eɹ ; stressed r-colored vowel decomposes
ɹ -> r / # _ ; ɹ is the trill word-initially
ɹ -> r / n _ ; ɹ is the trill after n
ɹ -> r / l _ ; ɹ is the trill after l
ɹ -> r / s _ ; ɹ is the trill after s
ɹ -> ɾ ; ɹ is the tap elsewhere
ɪ -> i ; ɪ is i
ɛ -> e ; ɛ is e
æ -> a ; æ is a
ʌ -> a ; ʌ is a
ə -> a ; ə is a
ɑ -> a ; ɑ is a
ɔ -> o ; ɔ is o
ʊ -> u ; ʊ is u
""",
    "flapping": "t -> ɾ / [vowel] _ [vowel] ; flapping\nd -> ɾ / [vowel] _ [vowel] ; flapping of d",
    "nasalization": "[vowel] -> [+nasalized] / _ [nasal] ; vowel nasalization",
}


def available() -> list[str]:
    return sorted(SHIPPED)


def shipped(name: str) -> list[P.Rule]:
    return P.parse_rules(SHIPPED[name])
