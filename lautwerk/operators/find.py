"""Matches of structural queries, and units that satisfy feature queries. All scans: no shuffle, no UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import inventory as I
from ..functions import algebra as A
from ..functions import text as X
from ..plans import automaton as T
from ..plans import patterns as P
from ..plans.terms import Query, QueryError, parse, symbols


def matching_units(form: Column, terms: str) -> Column:
    """(pos, unit) of the units of a transcription that satisfy a feature query; null and empty forms have none."""
    return sites(form, f"[{terms}]")


def sites(form: Column, spec: str, tiers: Column | None = None) -> Column:
    """(pos, unit) of every match of a structural query; pos counts units, or for a boundary the units before it. tiers: intervals
    (tier, start, end) of the form, in units, for a query that names a tier."""
    one = lambda t, x: F.struct(x["units"].alias("pos"), X.decode(T.joined(t, x["at"], F.lit(1))).alias("unit"))
    return _matched(form, spec, tiers, "array<struct<pos:bigint,unit:string>>", one)


def offsets(form: Column, spec: str, tiers: Column | None = None) -> Column:
    """Where the matches of a structural query begin, in code points of the form."""
    return _matched(form, spec, tiers, "array<bigint>", lambda t, x: F.length(X.decode(T.joined(t, F.lit(0), x["at"]))).cast("long"))


def count(form: Column, spec: str, tiers: Column | None = None) -> Column:
    """How many matches a structural query has, as the size of sites; they are counted without being listed."""
    pattern = P.parse_query(spec)
    bindings = P.bindings(pattern)
    if pattern.target.kind == "null" or len(bindings) > 1:  # values of a variable may match at the same places
        return F.size(sites(form, spec, tiers))
    return A.let(T.tokens_of(X.encode(form)), lambda t: sum((T.count(T.sites_in(t, T.Classes(pattern, values), tiers)) for values in bindings), F.lit(0)))


def _matched(form: Column, spec: str, tiers: Column | None, kind: str, one) -> Column:
    """What one makes of tokens and each place (see automaton.places), in order."""
    pattern = P.parse_query(spec)
    if pattern.target.kind == "null":
        raise QueryError("a query can't ask for a null")

    def found(t: Column, values: dict[str, str]) -> Column:
        at_sites = lambda m: F.transform(T.places(m), lambda x: one(t, x))
        return A.let(T.sites_in(t, T.Classes(pattern, values), tiers), lambda m: F.when(m.contains(T.SITE), at_sites(m)).otherwise(F.array().cast(kind)))

    def whole(t: Column) -> Column:
        own = [found(t, values) for values in P.bindings(pattern)]
        return own[0] if len(own) == 1 else F.array_sort(F.array_distinct(F.concat(*own)))

    return A.let(T.tokens_of(X.encode(form)), whole)


def find(df: DataFrame, form_col: str, spec: str, plain: bool = False, wild: bool = False, tiers_col: str | None = None) -> DataFrame:
    """A row for each match: the columns of df, pos and unit. plain: the forms have no marks, see text.plain. wild: the letters of
    the query are spelled as keyboards do, see text.normalize_lookalikes. tiers_col: intervals, see sites."""
    with X.plain(plain):
        return _find(df, form_col, wild_query(spec) if wild else spec, tiers_col)


def wild_query(spec: str) -> str:
    """A query with its look-alikes and ligatures replaced, but not inside brackets."""
    table = str.maketrans(I.LOOKALIKES | I.LIGATURES)
    return "".join(part if part.startswith("[") else part.translate(table) for part in re.split(r"(\[[^\]]*\])", spec))


def _find(df: DataFrame, form_col: str, spec: str, tiers_col: str | None) -> DataFrame:
    # an inner explode would have the sites found twice, once to see whether there are any
    site = X.free(df, "site")
    found = df.select("*", F.explode_outer(sites(F.col(form_col), spec, F.col(tiers_col) if tiers_col else None)).alias(site)).where(F.col(site).isNotNull())
    return found.select(*df.columns, F.col(f"{site}.pos").alias("pos"), F.col(f"{site}.unit").alias("unit"))


def phones_matching(terms: str) -> list[str]:
    """Inventory symbols that satisfy a feature query."""
    return symbols(parse(terms))


def phones_by_feature(feature: str, value: str) -> list[str]:
    return symbols(Query(required={feature: value}))
