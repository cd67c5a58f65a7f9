"""Operators over the roles of a corpus: queries, derivations, experiments and spreads of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import Corpus
from . import compare, find, rewrite

CLASSES = ("unchanged", "derived", "refused", "budget")


def query(corpus: Corpus, spec: str, role: str) -> DataFrame:
    """(entry_id, pos, unit): matches in one role of every entry. Other roles aren't read."""
    return find.find(corpus.forms(role).select("entry_id", "form"), "form", spec).select("entry_id", "pos", "unit")


def pairs(corpus: Corpus, source: str, target: str) -> DataFrame:
    """(entry_id, source, target) of the entries that have both roles."""
    a = corpus.forms(source).select("entry_id", F.col("form").alias("source"))
    return a.join(corpus.forms(target).select("entry_id", F.col("form").alias("target")), "entry_id")


def query_derivations(corpus: Corpus, source: str, target: str, rules: str, limit: int = 64) -> DataFrame:
    """(entry_id, source, target, verdict)."""
    return rewrite.derives(pairs(corpus, source, target), "source", "target", rules, limit)


def run_experiment(corpus: Corpus, source: str, target: str, rules: str, limit: int = 64) -> DataFrame:
    """(entry_id, source, target, class, rules): a report that names its rules and can be written and read as a table."""
    identity = rule_set_identity(rules)
    return rewrite.experiment(pairs(corpus, source, target), "source", "target", rules, limit).withColumn("rules", F.lit(identity))


def counts(report: DataFrame) -> DataFrame:
    """(class, n) with all four classes."""
    every = report.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    return every.join(F.broadcast(report.groupBy("class").agg(F.count("*").alias("n"))), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(report: DataFrame) -> float | None:
    """Share of the pairs that the rules account for; None without pairs."""
    r = report.agg(F.avg(F.col("class").isin("unchanged", "derived").cast("double"))).first()
    return r[0]


def rule_set_identity(rules: str) -> str:
    from ..functions.segments import identity_fingerprint

    return identity_fingerprint([[r.source, r.optional] for r in rewrite.rules_of(rules)])


def spread(corpus: Corpus, reference: str, *sources: str) -> DataFrame:
    """(entry_id, source, kind, left, right): how each source differs from the reference role."""
    other = corpus.forms(*sources).select("entry_id", F.col("role").alias("source"), F.col("form").alias("said"))
    joined = corpus.forms(reference).select("entry_id", F.col("form").alias("meant")).join(other, "entry_id")
    return compare.disagreements(joined, ["entry_id", "source"], "meant", "said")


def costs_from_rules(rules: str, low: float = 0.25) -> tuple[dict[str, float], dict[str, float]]:
    """(delete, insert): a low price for the units that rules delete or insert."""
    gone, new = {}, {}
    for r in rewrite.rules_of(rules):
        if r.change.kind == "null":
            from ..plans.terms import parse, symbols

            for s in [r.pattern.target.value] if r.pattern.target.kind == "literal" else symbols(parse(r.pattern.target.value)):
                gone[s] = low
        if r.pattern.target.kind == "null":
            new[r.change.value] = low
    return gone, new


def write_report(report: DataFrame, path: str) -> None:
    """A report or a spread as JSON lines; its rule set's identity is in its rows."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report as written; refuses files without a class, which are none."""
    out = spark.read.json(path)
    if "class" not in out.columns:
        raise ValueError(f"{path} holds no report")
    return out


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("entry_id string, source string, kind string, `left` string, `right` string").json(path)
