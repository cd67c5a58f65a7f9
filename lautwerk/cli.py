"""Command line: ``lautwerk GROUP COMMAND ...`` on strings, on lines of a file or on a column of a CSV file.

Forms are rows: each command is an expression over them, or a read of the inventory. Exit status 0, 2 for a bad request, 3
when something in the input can't be read.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inventory as I
from .functions import notation, segments, text
from .operators import analysis, compare, distance, find, intervals, rewrite
from .plans import patterns
from .plans.terms import QueryError
from .session import local_session
from .sources import corpus


def _words(column: Column) -> Column:
    return F.split(column, " ")


#: group: command: expression over a form.
FORMS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "convert": {
        "tokenize": text.units, "normalize": text.normalize, "wild": text.from_wild, "add-ties": text.add_ties, "to-xsampa": notation.to_xsampa, "from-xsampa": notation.from_xsampa,
        "to-kirshenbaum": notation.to_kirshenbaum, "from-kirshenbaum": notation.from_kirshenbaum, "to-timit": notation.to_timit, "from-timit": lambda c: notation.from_timit(_words(c)),
        "to-cmu": notation.to_cmu, "to-ipa": lambda c: notation.from_cmu(_words(c)), "to-json": segments.form_to_json, "from-json": lambda c: segments.form_from_json(c)["spelling"],
        "to-katakana": lambda c: segments.katakana_word(_words(c))["text"],
    },
    "analysis": {"validate": text.findings, "lost": text.lost},
    "rules": {"morae": lambda c: intervals.morae(c)["parts"], "units": text.units, "syllables": intervals.syllabify},
}
#: Commands whose input is something else than a transcription, so nothing of it can be lost.
FOREIGN = {"from-xsampa", "from-kirshenbaum", "from-timit", "to-ipa", "from-json", "to-katakana", "normalize", "wild", "validate", "lost"}


def _steps(column: Column) -> Column:
    return F.transform(column, lambda s: F.concat(s["name"], F.lit(": "), s["before"], F.lit(" > "), s["after"]))


#: group: command: expression over a form, for a rule or query.
SPECS: dict[str, dict[str, Callable[[DataFrame, str], DataFrame]]] = {
    "query": {
        "find": lambda df, q: df.withColumn("x", F.transform(find.sites(F.col("form"), q), lambda s: F.concat(s["pos"].cast("string"), F.lit(":"), s["unit"]))),
        "match": lambda df, q: df.withColumn("x", F.transform(find.matching_units(F.col("form"), q), lambda s: s["unit"])),
        "offsets": lambda df, q: df.withColumn("x", find.offsets(F.col("form"), q)),
    },
    "rules": {
        "apply": lambda df, r: df.withColumn("x", rewrite.rewrite(F.col("form"), _rules(r))),
        "trace": lambda df, r: rewrite.derive(df, "form", _rules(r)).withColumn("x", _steps(F.col("trace"))),
        "variants": lambda df, r: rewrite.variants(df, "form", _rules(r)).withColumn("x", F.transform("variants", lambda v: v["form"])),
        "recognize": lambda df, r: df.withColumn("x", rewrite.recognize(F.col("form"), _rules(r)[0])),
        "derives": lambda df, r: rewrite.derives(df.select("k", F.get(F.split("form", ">"), 0).alias("form"), F.get(F.split("form", ">"), 1).alias("target")), "form", "target", _rules(r)).withColumn("x", F.col("verdict")),
    },
}


def _rules(given: str) -> list:
    """A shipped set by name, or rules as written."""
    return rewrite.shipped(given) if given in rewrite.SHIPPED else rewrite.rules_of(given)


def _pairs(two: list[str]) -> tuple[str, str]:
    if len(two) != 2:
        raise QueryError("two are needed")
    return two[0], two[1]


def _word_cost(spark: SparkSession, args: list[str]) -> list:
    a, b = _pairs(args)
    return [distance.explain_word_distance(*[r["u"] for r in spark.createDataFrame([(0, a), (1, b)], "k int, f string").select("k", text.units(F.col("f")).alias("u")).orderBy("k").collect()])]


def _one(spark: SparkSession, args: list[str], f: Callable[[Column, Column], Column]) -> list:
    return [spark.createDataFrame([_pairs(args)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]]


#: group: command: rows to print, from the rest of the arguments.
READS: dict[str, dict[str, Callable[[SparkSession, list[str]], list]]] = {
    "analysis": {
        "describe": lambda s, a: [segments.describe(u) for u in a],
        "natural-class": lambda s, a: [f"{f}={v}" for f, v in analysis.natural_class(a).items()],
        "minimal-pairs": lambda s, a: distance.minimal_pairs(s).where(F.lit(not a) | F.col("a").isin(a) | F.col("b").isin(a)).collect(),
        "nearest": lambda s, a: distance.nearest_phones(s).where(F.col("a").isin(a)).orderBy("a", "rank").collect(),
    },
    "analyze": {
        "validate": lambda s, a: [" ".join(p) for p in analysis.integrity()], "summary": lambda s, a: analysis.summary(s).collect(),
        "counts": lambda s, a: analysis.feature_counts(s).orderBy("feature", "value").collect(), "usage": lambda s, a: analysis.feature_usage(s).orderBy("feature").collect(),
        "phones": lambda s, a: list(I.phones()), "diacritics": lambda s, a: [f"{m}\t{json.dumps(d)}" for m, d in I.DIACRITICS.items()],
        "report": lambda s, a: [*analysis.summary(s).collect(), *analysis.feature_usage(s).orderBy("feature").collect()],
    },
    "distance": {
        "pair": lambda s, a: [distance.phone_distance(*_pairs(a))], "segment": lambda s, a: distance.segment_terms(*_pairs(a)),
        "matrix": lambda s, a: [(x, y, distance.phone_distance(x, y)) for x in a for y in a], "confusability": lambda s, a: [distance.DistanceModel().confusability(*_pairs(a))],
        "word": lambda s, a: _one(s, a, distance.word_distance), "similarity": lambda s, a: _one(s, a, distance.word_similarity), "steps": _word_cost,
        "seq": lambda s, a: _one(s, a, lambda x, y: distance.sequence_distance(_words(x), _words(y))), "nearest": lambda s, a: distance.nearest_phones(s).where(F.col("a").isin(a)).orderBy("a", "rank").collect(),
        "directional": lambda s, a: _one(s, a, compare.directional_distance),
    },
    "features": {"features": lambda s, a: [json.dumps(I.bundle_of(u), ensure_ascii=False) for u in a]},
    "hierarchy": {
        "text": lambda s, a: [analysis.hierarchy_text(a or list(I.speech()))], "dot": lambda s, a: [analysis.hierarchy_dot(a or list(I.speech()))],
        "json": lambda s, a: [json.dumps([{"depth": d, "label": x, "phones": m} for d, x, m in analysis.hierarchy(a or list(I.speech()))], ensure_ascii=False)],
    },
    "info": {"stress": lambda s, a: [f"{m}\t{v}" for m, (f, v) in I.PROSODY.items() if f == "stress"]},
    "phoible": {
        "language": lambda s, a: corpus.read_phoible(s, a[0], language=a[1]).collect(), "inventory": lambda s, a: corpus.read_phoible(s, a[0], inventory=int(a[1])).collect(),
        "audit": lambda s, a: corpus.phoible_audit(corpus.read_phoible(s, a[0])).orderBy("InventoryID", "reason").collect(),
    },
    "query": {
        "list": lambda s, a: [" ".join(find.phones_matching(" ".join(a)))], "classes": lambda s, a: [f"{c}: {f} {' '.join(v)}" for c, (f, v) in I.CLASSES.items()],
        "features": lambda s, a: [f"{f}: {' '.join(vs)}" for f, vs in I.values().items() if not a or f in a], "shorts": lambda s, a: [f"{c}\t{f}={v}" for (f, v), c in analysis.shorts().items()],
    },
    "rules": {"list": lambda s, a: rewrite.available(), "show": lambda s, a: [r.source for r in rewrite.shipped(a[0])], "invertibility": lambda s, a: [*rewrite.invertibility(_rules(a[0])), rewrite.regime(_rules(a[0]))]},
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lautwerk")
    groups = parser.add_subparsers(dest="group", required=True)
    for group in sorted({*FORMS, *SPECS, *READS}):
        commands = groups.add_parser(group).add_subparsers(dest="command", required=True)
        for name in FORMS.get(group, {}) | SPECS.get(group, {}):
            p = commands.add_parser(name)
            if name in SPECS.get(group, {}):
                p.add_argument("spec")
            p.add_argument("forms", nargs="*")
            p.add_argument("--file", help="lines of a text file, or a CSV file with --column")
            p.add_argument("--column")
            p.add_argument("--filter", action="store_true", help="print the forms that have a result, not the results")
            p.add_argument("--format", choices=("text", "json"), default="text")
        for name in READS.get(group, {}):
            p = commands.add_parser(name)
            p.add_argument("args", nargs="*")
            p.add_argument("--format", choices=("text", "json"), default="text")
    return parser


#: Commands that may be given without their group, beside those whose name is in one group only.
SHORT = {"phones": ("query", "list"), "distance": ("distance", "pair"), "rewrite": ("rules", "apply"), "find": ("query", "find"), "validate": ("analysis", "validate")}


def _in_full(argv: list[str]) -> list[str]:
    """The arguments with the group put in where it was left out."""
    groups = {g: {*FORMS.get(g, {}), *SPECS.get(g, {}), *READS.get(g, {})} for g in (*FORMS, *SPECS, *READS)}
    if len(argv) > 1 and argv[1] in groups.get(argv[0], ()) or not argv:
        return argv
    own = [SHORT[argv[0]]] if argv[0] in SHORT else [(g, argv[0]) for g, names in groups.items() if argv[0] in names]
    return [*own[0], *argv[1:]] if len(own) == 1 else argv


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(_in_full(sys.argv[1:] if argv is None else argv))
    try:
        return _read(a) if hasattr(a, "args") else _run(a)
    except (QueryError, ValueError, KeyError) as e:
        print(e, file=sys.stderr)
        return 2


def _shown(row) -> str:
    return row if isinstance(row, str) else "\t".join(map(str, row)) if isinstance(row, (list, tuple)) else str(row)


def _read(a) -> int:
    rows = READS[a.group][a.command](local_session(), a.args)
    for row in rows:
        print(json.dumps(row.asDict() if hasattr(row, "asDict") else row, ensure_ascii=False) if a.format == "json" else _shown(row))
    return 0


def _input(spark: SparkSession, a) -> DataFrame:
    """(k, form): the forms in order, from the arguments, a file's lines or a CSV file's column."""
    if not a.file:
        return spark.createDataFrame(list(enumerate(a.forms)), "k long, form string").coalesce(1)
    if a.column:
        return spark.read.option("header", True).option("sep", "\t" if a.file.endswith(".tsv") else ",").csv(a.file).select(F.monotonically_increasing_id().alias("k"), F.col(a.column).alias("form"))
    return spark.read.text(a.file).select(F.monotonically_increasing_id().alias("k"), F.col("value").alias("form"))


def _run(a) -> int:
    df = _input(local_session(), a)
    spec = SPECS.get(a.group, {}).get(a.command)
    if spec and a.command in ("find", "match", "offsets"):
        patterns.parse_query(a.spec if a.command != "match" else f"[{a.spec}]")
    out = spec(df, a.spec) if spec else df.withColumn("x", FORMS[a.group][a.command](F.col("form")))
    lost = F.lit(False) if a.command in FOREIGN else F.size(text.lost(F.col("form"))) > 0
    status = 0
    for r in out.select("k", "form", "x", lost.alias("lost")).orderBy("k").toLocalIterator():
        status = 3 if r["lost"] else status
        if a.filter:
            if r["x"]:
                print(r["form"])
        elif a.format == "json":
            print(json.dumps({"form": r["form"], "result": r["x"]}, ensure_ascii=False))
        else:
            print(r["x"] if isinstance(r["x"], str) else " ".join(map(str, r["x"] or [])))
    return status


if __name__ == "__main__":
    sys.exit(main())
