"""Queries over tied units, distances, graphs and corpora, with SQL that states the phonetics of the letters itself.

The SQL's table of letters is written out from the public IPA chart, not taken from the library; places and articulators are
arcs along the vocal tract, channels are ranks. Letters of the corpus that follow each other are tied into one unit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inventory as I
from .functions import algebra as A
from .functions import notation as N
from .functions import text as X
from .operators import analysis, distance, find, graph, intervals, rewrite
from .session import scratch
from .sources import corpus
from .workload import _HEAD, _OPTIONAL, _SQL, _UNITS, _WORDS, _table, query, words

# What the chart says of each letter, and where it lies in the tract.
_PLACE_NAMES = "['bilabial', 'labiodental', 'dental', 'alveolar', 'postalveolar', 'alveolo-palatal', 'palatal', 'velar', 'uvular', 'pharyngeal', 'epiglottal', 'glottal']"
_IPA = """ipa(unit, manner, closed, voiced, channel, rounded, height, back, place, organ) AS (VALUES
 ('a', 'vowel', 0.00, '+', NULL, '-', 'open', 'front', NULL, NULL), ('b', 'plosive', 1.0, '+', NULL, NULL, NULL, NULL, [1], [0.0]),
 ('c', 'plosive', 1.0, '-', NULL, NULL, NULL, NULL, [7], [0.32]), ('d', 'plosive', 1.0, '+', NULL, NULL, NULL, NULL, [4], [0.13]),
 ('e', 'vowel', 0.27, '+', NULL, '-', 'close-mid', 'front', NULL, NULL), ('f', 'fricative', 0.8, '-', NULL, NULL, NULL, NULL, [2], [0.0]),
 ('ɡ', 'plosive', 1.0, '+', NULL, NULL, NULL, NULL, [8], [0.45]), ('h', 'fricative', 0.8, '-', NULL, NULL, NULL, NULL, [12], [1.0]),
 ('i', 'vowel', 0.40, '+', NULL, '-', 'close', 'front', NULL, NULL), ('j', 'approximant', 0.6, '+', NULL, NULL, NULL, NULL, [7], [0.32]),
 ('k', 'plosive', 1.0, '-', NULL, NULL, NULL, NULL, [8], [0.45]), ('l', 'approximant', 0.6, '+', 'lateral', NULL, NULL, NULL, [4], [0.13]),
 ('m', 'nasal', 1.0, '+', NULL, NULL, NULL, NULL, [1], [0.0]), ('n', 'nasal', 1.0, '+', NULL, NULL, NULL, NULL, [4], [0.13]),
 ('o', 'vowel', 0.27, '+', NULL, '+', 'close-mid', 'back', NULL, NULL), ('p', 'plosive', 1.0, '-', NULL, NULL, NULL, NULL, [1], [0.0]),
 ('q', 'plosive', 1.0, '-', NULL, NULL, NULL, NULL, [9], [0.45]), ('r', 'trill', 0.9, '+', NULL, NULL, NULL, NULL, [4], [0.13]),
 ('s', 'fricative', 0.8, '-', 'grooved', NULL, NULL, NULL, [4], [0.13]), ('t', 'plosive', 1.0, '-', NULL, NULL, NULL, NULL, [4], [0.13]),
 ('u', 'vowel', 0.40, '+', NULL, '+', 'close', 'back', NULL, NULL), ('v', 'fricative', 0.8, '+', NULL, NULL, NULL, NULL, [2], [0.0]),
 ('w', 'approximant', 0.6, '+', NULL, NULL, NULL, NULL, [1, 8], [0.0, 0.45]), ('x', 'fricative', 0.8, '-', NULL, NULL, NULL, NULL, [8], [0.45]),
 ('y', 'vowel', 0.40, '+', NULL, '+', 'close', 'front', NULL, NULL), ('z', 'fricative', 0.8, '+', 'grooved', NULL, NULL, NULL, [4], [0.13])),
arcs AS (SELECT [0.0, 0.03, 0.08, 0.13, 0.19, 0.24, 0.32, 0.45, 0.56, 0.74, 0.87, 1.0] AS arc)"""
_TIED = (
    f"WITH {_IPA}, {_WORDS}, {_UNITS}, pairs AS (SELECT DISTINCT unit AS a, after AS b FROM units WHERE after IS NOT NULL), "
    "tied AS (SELECT a || tie || b AS unit, tie = '͜' AS seq, x, y, x.manner <> y.manner AS phases FROM pairs, (VALUES ('͡'), ('͜')) t(tie), ipa x, ipa y WHERE x.unit = a AND y.unit = b)"
)


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, unit): letters that follow each other in some word, tied for one slot and for two; at most 26 x 26 x 2 rows."""
    at = F.sequence(F.lit(1), F.length("form") - 1)
    two = words(spark, sf_dir).where(F.length("form") > 1).select(F.explode_outer(F.transform(at, lambda i: F.substring(F.col("form"), i, F.lit(2)))).alias("ab")).distinct()
    a, b = F.substring("ab", 1, 1), F.substring("ab", 2, 1)
    return two.select(a.alias("a"), b.alias("b"), F.explode(F.array(F.concat(a, F.lit(I.TIE), b), F.concat(a, F.lit(I.SEQUENCE), b))).alias("unit"))


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tied(spark, sf_dir).withColumn("s", A.structure(F.col("unit"))).withColumn("b", A.bundles(F.col("s"), False))


@query(
    _TIED
    + """ SELECT unit, CASE WHEN seq THEN CASE WHEN x.manner = 'vowel' AND y.manner = 'vowel' THEN 'diphthong' ELSE 'chain' END
    WHEN NOT phases THEN CASE WHEN x.place <> y.place THEN 'double-articulation' ELSE 'overlay' END
    WHEN x.manner = 'plosive' AND y.manner = 'fricative' THEN 'affricate' WHEN x.manner = 'nasal' AND y.manner IN ('plosive', 'fricative') THEN 'prenasalized'
    WHEN x.manner IN ('plosive', 'fricative') AND y.manner = 'nasal' THEN 'pre-stopped' WHEN x.manner = 'plosive' AND y.manner = 'approximant' AND y.channel = 'lateral' THEN 'lateral-release'
    ELSE 'overlay' END AS kind, seq OR phases AS phased, CAST(2 AS BIGINT) AS n_children FROM tied"""
)
def tied_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _structures(spark, sf_dir)
    j = F.col("s.junctures")
    return s.select("unit", A.classify(F.col("b"), j).alias("kind"), A.phased(F.col("b"), j).alias("phased"), F.size(A.children(F.col("b"), j)).cast("long").alias("n_children"))


_PLACE = f"(list_transform({{}}.place, lambda k: {_PLACE_NAMES}[k]))"


@query(
    _TIED
    + f"""SELECT unit, feature, v1 || '|' || v2 AS both FROM (SELECT unit, unnest(['manner', 'voiced', 'channel', 'rounded', 'height', 'backness', 'place']) AS feature,
    unnest([x.manner, x.voiced, x.channel, x.rounded, x.height, x.back, array_to_string({_PLACE.format('x')}, '^')]) AS v1,
    unnest([y.manner, y.voiced, y.channel, y.rounded, y.height, y.back, array_to_string({_PLACE.format('y')}, '^')]) AS v2 FROM tied) WHERE v1 <> v2"""
)
def tied_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _structures(spark, sf_dir).select("unit", F.explode(F.map_entries(A.disagreements(F.col("b")))).alias("e"))
    return s.select("unit", F.col("e.key").alias("feature"), F.array_join("e.value", "|").alias("both"))


def _merged(f: str, scale: str) -> str:
    return f"CASE WHEN x.{f} = y.{f} OR y.{f} IS NULL THEN x.{f} WHEN x.{f} IS NULL THEN y.{f} ELSE array_to_string(list_sort([list_position({scale}, x.{f}), list_position({scale}, y.{f})]).list_transform(lambda k: {scale}[k]), '^') END"


def _flat(f: str, merged: str) -> str:
    return f"CASE WHEN seq THEN x.{f} WHEN phases THEN coalesce(y.{f}, x.{f}) ELSE {merged} END"


_BINARY = "CASE WHEN x.{0} = y.{0} OR y.{0} IS NULL THEN x.{0} WHEN x.{0} IS NULL THEN y.{0} ELSE '-' END"
_JOINED = f"array_to_string(list_transform(list_sort(list_distinct(list_concat(x.place, y.place))), lambda k: {_PLACE_NAMES}[k]), '^')"


@query(
    _TIED
    + f"""SELECT unit, CASE WHEN NOT seq AND x.manner = 'plosive' AND y.manner = 'fricative' THEN 'affricate' ELSE {_flat('manner', 'x.manner')} END AS manner,
    {_flat('voiced', _BINARY.format('voiced'))} AS voiced, {_flat('rounded', _BINARY.format('rounded'))} AS rounded,
    {_flat('channel', _merged('channel', "['lateral', 'flat', 'grooved']"))} AS channel,
    {_flat('height', _merged('height', "['open', 'near-open', 'open-mid', 'mid', 'close-mid', 'near-close', 'close']"))} AS height,
    {_flat('back', _merged('back', "['front', 'near-front', 'central', 'near-back', 'back']"))} AS backness,
    nullif(CASE WHEN seq THEN array_to_string({_PLACE.format('x')}, '^') WHEN phases THEN coalesce(array_to_string({_PLACE.format('y')}, '^'), array_to_string({_PLACE.format('x')}, '^')) ELSE {_JOINED} END, '') AS place FROM tied"""
)
def tied_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat bundle of each tied unit."""
    s = tied(spark, sf_dir).withColumn("m", A.scalar(A.structure(F.col("unit")), False))
    return s.select("unit", *(F.try_element_at("m", F.lit(f)).alias(f) for f in ("manner", "voiced", "rounded", "channel", "height", "backness", "place")))


@query(
    _TIED
    + """ SELECT unit, unit AS back, '{"type":"ipa-segment","v":3,"constituents":[' || array_to_string(list_transform([x.unit, y.unit], lambda u: '{"base":"' || u || '","modifiers":[],"approach":[]}'), ',')
    || '],"junctures":["' || CASE WHEN seq THEN 'seq' ELSE 'fuse' END || '"],"prosody":[]}' AS wire FROM tied"""
)
def tied_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = A.segment_to_json(A.structure(F.col("unit")))
    return tied(spark, sf_dir).select("unit", wire.alias("wire")).select("unit", "wire", A.to_ipa(A.segment_from_json(F.col("wire"))).alias("back"))


# -- distances --------------------------------------------------------------------------------------------------------

_SIDED = "list_avg(list_transform({0}, lambda p: list_min(list_transform({1}, lambda q: abs(p - q)))))"
_SETS = "greatest(" + _SIDED.format("{0}", "{1}") + ", " + _SIDED.format("{1}", "{0}") + ")"
_METRIC = f"""{_IPA}, own AS (SELECT unit, manner, manner = 'vowel' AS vowel, voiced, coalesce(rounded, '-') AS rounded, CASE channel WHEN 'lateral' THEN 0 WHEN 'grooved' THEN 2 ELSE 1 END AS channel,
  CASE manner WHEN 'vowel' THEN 0.4 ELSE closed END AS degree, closed, CASE back WHEN 'front' THEN 0.32 WHEN 'back' THEN 0.56 END AS back,
  list_transform(place, lambda k: arc[k]) AS arcs, organ, CASE WHEN unit = 'a' THEN [0.43] WHEN back = 'front' THEN [0.32] WHEN back = 'back' THEN [0.56] ELSE list_transform(place, lambda k: arc[k]) END AS at FROM ipa, arcs),
dist AS (SELECT x.unit AS a, y.unit AS b, CASE WHEN x.unit = y.unit THEN 0 ELSE (abs(x.degree - y.degree) / 0.6 + CAST(x.voiced <> y.voiced AS INT) + CAST(x.rounded <> y.rounded AS INT) + abs(x.channel - y.channel) / 2.0
  + CAST((x.manner = 'nasal') <> (y.manner = 'nasal') AS INT) + CAST((x.channel = 0) <> (y.channel = 0) AS INT)
  + CASE WHEN x.vowel AND y.vowel THEN abs(x.closed - y.closed) / 0.4 + abs(x.back - y.back) / 0.24 WHEN x.vowel OR y.vowel THEN 4 ELSE {_SETS.format('x.arcs', 'y.arcs')} + {_SETS.format('x.organ', 'y.organ')} END
  + {_SETS.format('x.at', 'y.at')} + abs(x.closed - y.closed)) / CASE WHEN x.vowel <> y.vowel THEN 22 ELSE 20 END END AS d FROM own x, own y)"""
#: Twelve more features have the same default for all letters; they are in the number of terms only.
_METRIC_HEAD = f"WITH {_METRIC} "


#: What the words have: units, pairs of neighbours, and distances among these units.
_ATTESTED = (
    f"WITH {_METRIC}, {_WORDS}, {_UNITS}, att AS (SELECT unit, CAST(sum(n) AS BIGINT) AS n FROM units GROUP BY unit), two AS (SELECT unit AS a, after AS b, CAST(sum(n) AS BIGINT) AS n FROM units WHERE after IS NOT NULL GROUP BY ALL), "
    "near AS (SELECT a, b, d FROM dist WHERE a IN (SELECT unit FROM att) AND b IN (SELECT unit FROM att)), "
    "conf AS (SELECT x.a, x.b, round(CASE WHEN x.a = x.b THEN 1 ELSE (SELECT count(*) FILTER (round(y.d, 9) >= round(x.d, 9)) / count(*) FROM near y WHERE y.a < y.b) END, 6) AS confusability FROM near x) "
)


def unit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, n): the units of all words and how often they occur."""
    w = words(spark, sf_dir).select(F.explode_outer(F.split("form", "")).alias("unit"), "n").where("unit <> ''")
    return w.groupBy("unit").agg(F.sum("n").alias("n"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, n): units that follow each other in words, and how often."""
    at = F.sequence(F.lit(1), F.length("form") - 1)
    two = words(spark, sf_dir).where(F.length("form") > 1).select(F.explode_outer(F.transform(at, lambda i: F.substring(F.col("form"), i, F.lit(2)))).alias("ab"), "n")
    return two.groupBy(F.substring("ab", 1, 1).alias("a"), F.substring("ab", 2, 1).alias("b")).agg(F.sum("n").alias("n"))


def _letters(spark: SparkSession, sf_dir: str) -> list[str]:
    """The symbols that the words have, at most those of the inventory."""
    return sorted(r["unit"] for r in unit_totals(spark, sf_dir).where(F.col("unit").isin(*I.phones())).select("unit").collect())


@query(_ATTESTED + "SELECT a, b, round(CAST(d AS DOUBLE), 6) AS d FROM near")
def letter_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of units that the words have, from the metric's table."""
    own, t = unit_totals(spark, sf_dir), distance.distance_table(spark)
    return t.join(own.select(F.col("unit").alias("a")), "a", "left_semi").join(own.select(F.col("unit").alias("b")), "b", "left_semi").select("a", "b", F.round("d", 6).alias("d"))


@query(_ATTESTED + "SELECT a, b, two.n AS n, round(CAST(d AS DOUBLE), 6) AS d FROM two JOIN near USING (a, b)")
def phone_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of neighbours in words, and how often they are neighbours."""
    return neighbours(spark, sf_dir).join(F.broadcast(distance.distance_table(spark)), ["a", "b"]).select("a", "b", "n", F.round("d", 6).alias("d"))


@query(_ATTESTED + "SELECT a, b, CAST(r AS INTEGER) AS rank FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS r FROM near WHERE a <> b) WHERE r <= 3")
def nearest_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.nearest_phones(spark, 3, _letters(spark, sf_dir)).select("a", "b", F.col("rank").cast("int").alias("rank"))


@query(_ATTESTED + "SELECT a, att.n AS n, b, round(CAST(d AS DOUBLE), 6) AS d, CAST(r AS INTEGER) AS rank FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS r FROM near WHERE a <> b) JOIN att ON att.unit = a WHERE r <= 5")
def nearest_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each unit of the words, with how often it occurs."""
    near = distance.nearest_phones(spark, 5, _letters(spark, sf_dir))
    return unit_totals(spark, sf_dir).withColumnRenamed("unit", "a").join(F.broadcast(near), "a").select("a", "n", "b", F.round("d", 6).alias("d"), "rank")


@query(_ATTESTED + "SELECT * FROM conf")
def confusable_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentile of each pair's similarity among all pairs of units that the words have."""
    return distance.DistanceModel(_letters(spark, sf_dir)).table(spark).select("a", "b", F.round("confusability", 6).alias("confusability"))


@query(_ATTESTED + "SELECT a, CAST(sum(n) AS BIGINT) AS n, round(sum(n * confusability) / sum(n), 6) AS confusability FROM two JOIN conf USING (a, b) GROUP BY a")
def confusability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How confusable units are with what follows them in words, on average."""
    t = distance.DistanceModel(_letters(spark, sf_dir)).table(spark).select("a", "b", F.round("confusability", 6).alias("c"))
    return neighbours(spark, sf_dir).join(F.broadcast(t), ["a", "b"]).groupBy("a").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("n"), 6).alias("confusability"))


_BUNDLES = "bundles AS (SELECT unit, n, unnest(['manner', 'voiced', 'channel', 'rounded', 'height', 'backness']) AS feature, unnest([manner, voiced, coalesce(channel, 'flat'), coalesce(rounded, '-'), height, back]) AS value, unnest([true, true, channel IS NOT NULL, rounded IS NOT NULL, true, true]) AS stated FROM att JOIN ipa USING (unit)) "
_ASKED = ("manner", "voiced", "channel", "rounded", "height", "backness")


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, n, feature, value, stated) of the units of the words, for some features."""
    own = analysis.feature_table(spark).where(F.col("feature").isin(*_ASKED)).withColumnRenamed("symbol", "unit")
    return unit_totals(spark, sf_dir).join(F.broadcast(own), "unit")


@query(_ATTESTED[:-1] + f", {_BUNDLES} SELECT feature, value, CAST(sum(n) AS BIGINT) AS n FROM bundles WHERE value IS NOT NULL GROUP BY ALL")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all words by what some features are."""
    return _bundles(spark, sf_dir).groupBy("feature", "value").agg(F.sum("n").alias("n"))


@query(_ATTESTED[:-1] + f", {_BUNDLES} SELECT feature, count(*) FILTER (stated AND value IS NOT NULL) AS n FROM bundles GROUP BY feature")
def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different units of the words state a feature."""
    return _bundles(spark, sf_dir).groupBy("feature").agg(F.count(F.when(F.col("stated"), 1)).alias("n"))


@query(
    _ATTESTED[:-1] + ", f AS (SELECT unit, [manner, voiced, coalesce(channel, 'flat'), coalesce(rounded, '-'), coalesce(height, ''), coalesce(back, ''), array_to_string(coalesce(place, []), '^'), CASE unit WHEN 'a' THEN 'central' ELSE '' END] AS v FROM att JOIN ipa USING (unit)), "
    "d AS (SELECT x.unit AS a, y.unit AS b, len(list_filter(list_zip(x.v, y.v), lambda p: p[1] <> p[2])) AS n FROM f x JOIN f y ON x.unit < y.unit) SELECT a, b, coalesce(two.n, 0) AS n FROM d LEFT JOIN two USING (a, b) WHERE d.n = 1"
)
def minimal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the words that differ in one feature, and how often the second follows the first."""
    own = unit_totals(spark, sf_dir)
    pairs = distance.minimal_pairs(spark).join(own.select(F.col("unit").alias("a")), "a", "left_semi").join(own.select(F.col("unit").alias("b")), "b", "left_semi")
    return pairs.join(neighbours(spark, sf_dir), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"WITH {_METRIC}, {_WORDS}, {_UNITS}, pairs AS (SELECT DISTINCT unit AS a, after AS b FROM units WHERE after IS NOT NULL), m AS (SELECT unit, manner FROM ipa) "
    "SELECT a || tie || b AS unit, round(CAST(CASE WHEN tie = '͡' AND p.manner = q.manner THEN d / 2 + 0.05 ELSE (d + 1) / 4 END AS DOUBLE), 6) AS d FROM pairs JOIN dist USING (a, b) JOIN m p ON p.unit = a JOIN m q ON q.unit = b, (VALUES ('͡'), ('͜')) t(tie)"
)
def tied_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tied unit against its first letter: parts in order cost the nearest one, a term of their own and the tie; parts in no
    order half the distance of the second and a share for being there."""
    return tied(spark, sf_dir).select("unit", F.round(distance.unit_distance(F.col("a"), F.col("unit")), 6).alias("d"))


def _edit_costs(name: str, cost: str) -> str:
    """Rows of the table of an edit distance, one after another: a row is a list, made from the row before by a fold over the letters
    of the other word. Gaps cost 1."""
    return f"""{name}_subs AS (SELECT p.a, p.b, i, list([CAST(j AS DOUBLE), CAST({cost} AS DOUBLE)] ORDER BY j) AS subs FROM pairs p, unnest(range(1, length(p.a) + 1)) r(i), unnest(range(1, length(p.b) + 1)) s(j)
  JOIN dist d ON d.a = substr(p.a, i, 1) AND d.b = substr(p.b, j, 1) GROUP BY ALL),
{name}_dp(a, b, i, line) AS (SELECT a, b, CAST(0 AS BIGINT), list_transform(range(length(b) + 1), lambda k: CAST(k AS DOUBLE)) FROM pairs
  UNION ALL SELECT t.a, t.b, t.i + 1, list_reduce(subs, lambda acc, x: list_append(acc, least(line[CAST(x[1] AS BIGINT)] + x[2], line[CAST(x[1] AS BIGINT) + 1] + 1, acc[-1] + 1)), [CAST(t.i + 1 AS DOUBLE)])
  FROM {name}_dp t JOIN {name}_subs u ON u.a = t.a AND u.b = t.b AND u.i = t.i + 1),
{name} AS (SELECT a, b, line[-1] AS cost FROM {name}_dp WHERE i = length(a))"""


_PART_PAIRS = "w AS (SELECT DISTINCT unnest(string_split(replace(p_name, 'g', 'ɡ'), ' ')) AS w FROM part), pairs AS (SELECT x.w AS a, y.w AS b FROM w x JOIN w y ON x.w < y.w)"
_SQL["word_similarity"] = (
    f"WITH RECURSIVE {_METRIC}, {_PART_PAIRS}, {_edit_costs('weighted', '2 * d.d')}, {_edit_costs('plain', 'CASE WHEN d.a = d.b THEN 0 ELSE 2 END')} "
    "SELECT a, b, round(1 - weighted.cost / (length(a) + length(b)), 6) AS similarity, round(plain.cost, 6) AS unweighted, round(least(length(a), length(b)) / greatest(length(a), length(b)), 6) AS coverage FROM weighted JOIN plain USING (a, b)"
)


# -- notation and rules -----------------------------------------------------------------------------------------------

# The public correspondence of the letters that ARPABET has.
_ARPABET = "arpabet(unit, symbol) AS (VALUES ('i', 'IY0'), ('u', 'UW0'), ('j', 'Y'), ('w', 'W'), ('m', 'M'), ('n', 'N'), ('l', 'L'), ('p', 'P'), ('b', 'B'), ('t', 'T'), ('d', 'D'), ('k', 'K'), ('ɡ', 'G'), ('f', 'F'), ('v', 'V'), ('s', 'S'), ('z', 'Z'), ('h', 'HH'))"


@query(f"WITH {_ARPABET}, {_WORDS}, {_UNITS} SELECT form, coalesce(string_agg(symbol, ' ' ORDER BY pos), '') AS cmu, coalesce(string_agg(a.unit, '' ORDER BY pos), '') AS back FROM units u LEFT JOIN arpabet a USING (unit) GROUP BY form")
def arpabet_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmu = N.to_cmu(F.col("form"))
    return words(spark, sf_dir).select("form", F.array_join(cmu, " ").alias("cmu"), N.from_cmu(cmu).alias("back"))


@query(_HEAD + "SELECT form, CAST(pos AS INTEGER) AS at, unit AS removed, 'ɾ' AS added FROM units JOIN letters l USING (unit) JOIN letters b ON b.unit = before JOIN letters c ON c.unit = after WHERE unit = 't' AND b.vowel AND c.vowel")
def rule_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rule takes away and puts in, and where."""
    with X.plain():
        found = rewrite.edits(F.col("form"), "t -> ɾ / [vowel] _ [vowel]")
    e = words(spark, sf_dir).select("form", F.explode_outer(found).alias("e")).where("e is not null")
    return e.select("form", "e.at", "e.removed", "e.added")


@query(f"WITH {_WORDS}, m AS (SELECT form || '#' || form AS form FROM words), u AS (SELECT form, unnest(range(length(form))) AS place FROM m) SELECT form, CAST(place AS BIGINT) AS place FROM u WHERE substr(form, place + 1, 1) = 'n' AND (place + 1 = length(form) OR substr(form, place + 2, 1) = '#')")
def match_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points at which a word ends in n; each word stands twice, with a boundary between."""
    w = words(spark, sf_dir).select(F.concat_ws("#", "form", "form").alias("form"))
    with X.plain():
        found = find.offsets(F.col("form"), "n / _ #")
    return w.select("form", F.explode_outer(found).alias("place")).where("place is not null")


@query(_HEAD + "SELECT form, CAST(pos AS BIGINT) AS pos FROM units u WHERE unit = 't' AND regexp_matches(substr(form, 1, pos), 's[^aeiouy]*$') ")
def query_open_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t after s and any number of units that aren't vowels."""
    return find.find(words(spark, sf_dir).select("form"), "form", "t / s ([-vowel])* _", plain=True).select("form", "pos")


@query(_HEAD + "SELECT form, CAST(pos AS BIGINT) AS pos FROM units u WHERE unit = 't' AND regexp_matches(substr(form, pos + 2), '^[^aeiouy]*s') ")
def query_open_span_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t before any number of units that aren't vowels, and s."""
    return find.find(words(spark, sf_dir).select("form"), "form", "t / _ ([-vowel])* s", plain=True).select("form", "pos")


@query(
    _HEAD
    + r", m AS (SELECT form, regexp_extract_all(form, '[^aeiouy]?j?[aeiouy]|[mn]') AS parts FROM words) SELECT form, array_to_string(parts, '.') AS morae, CAST(length(form) - length(array_to_string(parts, '')) AS BIGINT) AS n_rest FROM m"
)
def morae_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morae: (consonant) (j) vowel, or a nasal alone; what fits none is counted."""
    m = words(spark, sf_dir).withColumn("m", intervals.morae(F.col("form")))
    return m.select("form", F.array_join("m.parts", ".").alias("morae"), F.size("m.rest").cast("long").alias("n_rest"))


# Words with a stress mark before them, long vowels, and a syllable break after each that isn't the last sound.
_MARKED = f"WITH {_WORDS}, m AS (SELECT form, n, 'ˈ' || regexp_replace(regexp_replace(form, '([aeiouy])', '\\1ː', 'g'), 'ː(.)', 'ː.\\1', 'g') AS marked, len(regexp_extract_all(form, '[aeiouy]')) AS nv FROM words) "


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.regexp_replace("form", "([aeiouy])", "$1ː")
    return words(spark, sf_dir).withColumn("marked", F.concat(F.lit("ˈ"), F.regexp_replace(long, "ː(.)", "ː.$1")))


@query(
    _MARKED
    + """SELECT marked, 'ˈ' || array_to_string(list_transform(string_split(form, ''), lambda c: CASE WHEN contains('aeiouy', c) THEN c || 'ː' ELSE c END), ' ') AS segmented,
    CAST(1 + nv AS BIGINT) AS n_prosody, CAST(length(marked) - length(replace(marked, '.', '')) AS BIGINT) AS n_breaks,
    CASE WHEN nv > 0 AND contains('aeiouy', left(form, 1)) THEN '1' || repeat('0', nv - 1) ELSE repeat('0', nv) END AS signature, replace(replace(replace(marked, 'ˈ', ''), 'ː', ''), '.', '') AS bare FROM m"""
)
def marked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of forms with stress, length and syllable breaks."""
    f = F.col("marked")
    bare = F.array_join(F.transform(X.units(f), X.bare), "")
    counts = (F.size(X.prosody(f)).cast("long").alias("n_prosody"), F.size(X.boundaries(f)).cast("long").alias("n_breaks"))
    return marked(spark, sf_dir).select("marked", X.segmented(f).alias("segmented"), *counts, intervals.stress_signature(f).alias("signature"), bare.alias("bare"))


@query(_MARKED + "SELECT marked, regexp_replace(marked, '([aeiouy])(ː[.]?)([mn])', '\\1\u0303\\2\\3', 'g') AS surface FROM m")
def marked_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long vowels before nasals, over a syllable break, become nasal; their length stays behind the new mark."""
    return marked(spark, sf_dir).select("marked", rewrite.rewrite(F.col("marked"), "[vowel length=long] -> [+nasalized] / _ [nasal]").alias("surface"))


_SQL["cmu_round_trip"] = _SQL["arpabet_and_back"]


# -- graphs -----------------------------------------------------------------------------------------------------------


def _edges(df: DataFrame, graph_id: int, src, tgt, ordinal=None) -> DataFrame:
    return df.select(F.lit(graph_id).alias("graph"), F.lit("contains").alias("name"), src.alias("src"), (F.lit(0) if ordinal is None else ordinal).cast("int").alias("ordinal"), tgt.alias("tgt"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = _table(spark, sf_dir, "nation"), F.col("n_nationkey")
    named = lambda x: F.concat(F.lit("n"), x)
    return _edges(n.where(k < 24), 1, named(k), named(k + 1)).unionAll(_edges(n, 2, named(k), named((k + 1) % 25))).unionAll(_edges(n, 2, named(k), F.concat(F.lit("leaf"), k), F.lit(1)))


@query("SELECT 'n' || n_nationkey AS node, CAST(n_nationkey AS INTEGER) AS depth FROM nation WHERE n_nationkey > 0")
def graph_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one chain: everything below its head, at any depth."""
    roots = spark.createDataFrame([(1, "n0")], "graph int, root string")
    return graph.descendants(_chain(spark, sf_dir), roots).select("node", "depth")


@query("SELECT CAST(2 AS INTEGER) AS graph, 'n' || n_nationkey AS node FROM nation")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain, and a ring of the same nodes with a leaf at each: only the ring's nodes reach themselves."""
    return graph.cycles(_chain(spark, sf_dir)).select("graph", "node")


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and key classes both contain nations, which contain suppliers in the order of their keys."""
    n, s = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    k = F.col("n_nationkey")
    up = _edges(n, 1, F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), k), k).unionAll(_edges(n, 1, F.concat(F.lit("c"), k % 2), F.concat(F.lit("n"), k), k))
    return up.unionAll(_edges(s, 1, F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"), F.col("s_suppkey")))


@query("SELECT 's' || s_suppkey AS node, 'n' || s_nationkey || '/' || top AS route FROM supplier JOIN nation ON s_nationkey = n_nationkey, unnest(['r' || n_regionkey, 'c' || n_nationkey % 2]) t(top)")
def graph_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "supplier").select(F.lit(1).alias("graph"), F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.ancestor_routes(_lattice(spark, sf_dir), nodes).select("node", F.array_join("route", "/").alias("route"))


@query(
    "SELECT 'r' || n_regionkey AS root, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, s_suppkey) - 1 AS BIGINT) AS place, coalesce('s' || s_suppkey, 'n' || n_nationkey) AS node "
    "FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey"
)
def graph_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each region expands to: the suppliers of its nations, and nations without any, in walk order."""
    roots = _table(spark, sf_dir, "region").select(F.lit(1).alias("graph"), F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return graph.expand_phrase(_lattice(spark, sf_dir), roots).select("root", "place", "node")


# -- corpora ----------------------------------------------------------------------------------------------------------


@query("SELECT 'n' || n_nationkey AS entry_id, replace(CASE WHEN n_nationkey % 3 = 0 THEN reverse(lower(n_name)) ELSE lower(n_name) END, 'g', 'ɡ') AS form, CASE WHEN n_nationkey % 3 = 0 THEN '2' ELSE '1' END AS version FROM nation WHERE n_nationkey % 5 <> 4")
def corpus_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names as entries; every third form is put again, reversed; some entries are removed."""
    n = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("entry_id"), F.lit("{}").alias("meta"), X.from_wild(F.lower("n_name"), ascii_only=True).alias("form"), F.col("n_nationkey").alias("k"))
    c = corpus.create(spark, f"{scratch(spark)}/corpus-{uuid.uuid4().hex}")
    c.add(n, {"cited": "form"}, "names", "1")
    c.put_forms("cited", n.where("k % 3 = 0").select("entry_id", F.reverse("form").alias("form")), "names", "2")
    return corpus.remove(c, n.where("k % 5 = 4")).forms("cited").select("entry_id", "form", "version")


@query(
    "SELECT 's' || s_suppkey AS entry_id, unnest(list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'bad_meta' END, CASE WHEN s_suppkey % 5 = 0 THEN 'missing_asset' END, CASE WHEN s_suppkey % 7 = 0 THEN 'unknown_symbol' END], lambda x: x IS NOT NULL)) AS code FROM supplier "
    "UNION ALL SELECT 's0' || s_suppkey, 'orphan_asset' FROM supplier WHERE s_suppkey % 5 = 0"
)
def corpus_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entries, some with metadata that is no object, a form with a strange symbol, or an asset under another id."""
    k = F.col("s_suppkey")
    form = F.when(k % 7 == 0, "ta7a").otherwise("tata")
    s = _table(spark, sf_dir, "supplier").select(k.alias("k"), F.concat(F.lit("s"), k).alias("entry_id"), F.when(k % 4 == 0, "[1]").otherwise("{}").alias("meta"), form.alias("form"))
    c = corpus.create(spark, f"{scratch(spark)}/corpus-{uuid.uuid4().hex}")
    c.add(s, {"cited": "form"}, "made", "1")
    corpus.put_assets(c, s.select(F.when(F.col("k") % 5 == 0, F.concat(F.lit("s0"), "k")).otherwise(F.col("entry_id")).alias("entry_id"), F.lit("wav").alias("kind"), F.lit("x.wav").alias("path")), check=False)
    return c.validate().select("entry_id", "code")


# -- optional rules ---------------------------------------------------------------------------------------------------


@query(
    _HEAD
    + "SELECT form, unnest(list_distinct(list_concat(CASE WHEN l.obstruent THEN [form, left(form, length(form) - 1) || l.devoiced] ELSE [form] END, "
    "list_transform(CASE WHEN l.obstruent THEN [form, left(form, length(form) - 1) || l.devoiced] ELSE [form] END, lambda f: replace(f, 'ti', 'si'))))) AS variant "
    "FROM words JOIN letters l ON l.unit = right(form, 1) WHERE length(form) - length(replace(form, 'ti', '')) <= 2"
)
def variant_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants of the words with at most one site of assibilation."""
    w = words(spark, sf_dir).where(F.length("form") - F.length(F.replace("form", F.lit("ti"), F.lit(""))) <= 2)
    v = rewrite.variants(w, "form", _OPTIONAL, plain=True)
    # an inner explode would have the variants found twice, once to see whether there are any
    return v.select("form", F.explode_outer("variants").alias("v")).where("v is not null").select("form", F.col("v.form").alias("variant"))
