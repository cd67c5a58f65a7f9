"""Queries over nearest forms, tracks, graphs built from events, rendered trees and composed vocabularies, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import transducer
from .operators import build, compare, nearest, render, rewrite, tracks
from .plans import patterns
from .workload import _HEAD, _WORDS, _table, query, spread, words


@query(
    f"WITH {_WORDS}, q AS (SELECT DISTINCT replace(unnest(regexp_extract_all(text, '[a-z]+')), 'g', 'ɡ') AS form FROM benchmark), d AS (SELECT q.form, w.form AS nearest, levenshtein(replace(q.form, 'ɡ', 'g'), replace(w.form, 'ɡ', 'g')) AS distance FROM q JOIN words w ON w.form <> q.form) "
    "SELECT form, CAST(min(distance) AS INTEGER) AS distance, min(nearest) FILTER (distance = least) AS nearest FROM (SELECT *, min(distance) OVER (PARTITION BY form) AS least FROM d) GROUP BY form"
)
def nearest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each distinct word of the benchmark the nearest other one of all distinct words of the documents: through pivots, against all pairs."""
    text = _table(spark, sf_dir, "benchmark").select(F.explode_outer(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1)).alias("word")).where("word is not null")
    asked = text.distinct().select(X.from_wild(F.col("word"), ascii_only=True).alias("form"))
    return nearest.nearest(asked, "form", words(spark, sf_dir).select("form"), "form").select("form", F.col("distance").cast("int").alias("distance"), "nearest")


_DAY = 86_400_000_000


@query(
    f"""WITH s AS (SELECT user_id, epoch_us(ts) AS t, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL),
    g AS (SELECT user_id, unnest(range(min(t) // {_DAY} * {_DAY}, max(t) + {_DAY}, {_DAY})) AS t FROM s GROUP BY user_id),
    b AS (SELECT g.user_id, g.t, s.t AS t0, s.value AS v0 FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.t >= s.t),
    a AS (SELECT b.*, s.t AS t1, s.value AS v1 FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.t <= s.t)
    SELECT user_id, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS value FROM a"""
)
def event_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each user's events as a track, read at the start of each day from before the first to after the last."""
    e = _table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("track"), F.expr("unix_micros(cast(ts as timestamp))").alias("t"), F.col("value").cast("double").alias("value"))
    days = e.groupBy("track").agg((F.floor(F.min("t") / _DAY) * _DAY).alias("lo"), F.max("t").alias("hi"))
    asked = days.select("track", F.explode(F.sequence("lo", F.col("hi") + _DAY - 1, F.lit(_DAY).cast("long"))).alias("t"))
    r = tracks.resample(e, asked, 7 * _DAY)
    return r.select(F.col("track").alias("user_id"), "t", F.round("value", 6).alias("value"))


_PART = "coalesce(length({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase')),
    n AS (SELECT *, lead(event_type) OVER w AS next, lead(t) OVER w AS stop FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT user_id, t AS start, stop, sha256('session|' || """
    + " || '|' || ".join(_PART.format(c) for c in ("user_id", "t", "stop"))
    + ") AS node FROM n WHERE event_type = 'signup' AND next = 'purchase'"
)
def session_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from a signup to the next purchase, under names made of what they are; the events are loaded twice and merged."""

    def load() -> DataFrame:
        e = _table(spark, sf_dir, "events").withColumn("t", F.expr("unix_micros(cast(ts as timestamp))"))
        found, _ = build.spans(e, ["user_id"], "t", "event_type", "signup", "purchase", "event_id")
        return build.nodes(found, "session", ["user_id", "start", "stop"])

    return build.merge(load(), load()).select("user_id", "start", "stop", "node")


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase')),
    n AS (SELECT *, lead(event_type) OVER w AS next, lag(event_type) OVER w AS prior FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT user_id, count(*) FILTER (event_type = 'signup' AND next IS DISTINCT FROM 'purchase') AS unfinished, count(*) FILTER (event_type = 'purchase' AND prior IS DISTINCT FROM 'signup') AS stray FROM n GROUP BY user_id"""
)
def session_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups without a purchase after them, and purchases without a signup before."""
    e = _table(spark, sf_dir, "events").withColumn("t", F.expr("unix_micros(cast(ts as timestamp))"))
    _, rest = build.spans(e, ["user_id"], "t", "event_type", "signup", "purchase", "event_id")
    users = e.where("event_type in ('signup', 'purchase')").select("user_id").distinct()
    n = rest.groupBy("user_id").agg(*(F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in ("unfinished", "stray")))
    return users.join(n, "user_id", "left").select("user_id", *(F.coalesce(r, F.lit(0)).alias(r) for r in ("unfinished", "stray")))


@query("SELECT p_partkey, replace(replace(regexp_replace(p_name, '([aeiouy])([^aeiouy ])([aeiouy])', '\\1.\\2\\3', 'g'), 'g', 'ɡ'), ' ', '#') AS form FROM part")
def rendered_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with breaks as trees of words, syllables and segments, and back to forms under a profile."""
    spaced = F.replace(F.regexp_replace("p_name", "([aeiouy])([^aeiouy ])([aeiouy])", "$1.$2$3"), F.lit(" "), F.lit("#"))
    p = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", X.from_wild(spaced, ascii_only=True).alias("form"))
    profile = spark.createDataFrame([("utterance", "", "#", ""), ("word", "", ".", "")], "tier string, before string, between string, after string")
    out = render.render(compare.tree(p, "p_partkey", "form"), render.labels(p, "p_partkey", "form"), profile)
    return out.select(F.col("graph").cast("long").alias("p_partkey"), F.col("text").alias("form"))


# A small set of symbols for the letters, in which voiced obstruents are written as voiceless ones and h as nothing.
_ATOMS = {**{c: c.upper() for c in "aeioumnlrptks"}, "b": "B", "d": "D", "ɡ": "G", "v": "V", "z": "Z", "f": "F", "j": "Y", "w": "W", "h": "H", "x": "X"}
_ALIASES = {"c": "k", "q": "c", "y": "j"}
_REDUCTIONS = {"b": "p", "d": "t", "ɡ": "k", "v": "f", "z": "s", "x": "h"}


@query(
    _HEAD[:-1]
    + ", m AS (SELECT form, pos, CASE WHEN unit IN ('h', 'x') THEN '' ELSE upper(translate(unit, 'bdɡvzcqyj', 'ptkfskkyy')) END AS s FROM units) "
    "SELECT form, string_agg(s, ' ' ORDER BY pos) FILTER (s <> '') AS symbols, coalesce(string_agg(CASE s WHEN 'Y' THEN 'j' ELSE lower(s) END, '' ORDER BY pos) FILTER (s <> ''), '') AS back FROM m GROUP BY form"
)
def vocabulary_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in a small set of symbols by aliases of aliases and reductions, some to nothing, and back."""
    v = transducer.compose(_ATOMS, _ALIASES, _REDUCTIONS, ("h",))
    w = words(spark, sf_dir).select("form", v.map(F.col("form")).alias("m"))
    return w.select("form", F.when(F.size("m.symbols") > 0, F.array_join("m.symbols", " ")).alias("symbols"), v.read(F.col("m.symbols"))["form"].alias("back"))


@query(
    "WITH f AS (SELECT p_partkey, replace(p_name, ' ', '#') || CASE p_partkey % 3 WHEN 0 THEN '␣' WHEN 1 THEN '∅' ELSE '' END AS f FROM part) "
    "SELECT p_partkey, regexp_replace(f, '[^#␣∅]', '', 'g') AS extensions, NOT regexp_matches(f, '[#␣∅]') AS pure FROM f"
)
def off_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What part names, with boundaries, silence and zeros, have that isn't on the chart."""
    k = F.col("p_partkey")
    form = F.concat(F.replace("p_name", F.lit(" "), F.lit("#")), F.when(k % 3 == 0, "␣").when(k % 3 == 1, "∅").otherwise(""))
    return spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", F.array_join(X.extensions_in(form), "").alias("extensions"), X.is_pure(form).alias("pure"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(replace(replace(p_name, 'g', 'ɡ'), ' ', '#'), '([aeiouy]#?)t', '\\1ɾ', 'g'), '^#', '') AS surface FROM part")
def query_as_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with a replacement as a rule: t after a vowel, or after a vowel and a word's end."""
    form = X.from_wild(F.replace("p_name", F.lit(" "), F.lit("#")), ascii_only=True)
    rules = [patterns.query_rule("t / [vowel] _", "ɾ"), patterns.query_rule("t / [vowel] # _", "ɾ")]
    return spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", rewrite.rewrite(form, rules, plain=True).alias("surface"))
