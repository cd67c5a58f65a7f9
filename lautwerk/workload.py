"""Queries over the test tables, each with an independent SQL formulation where SQL can express it.

The tables hold no transcriptions, but runs of lower-case ASCII letters are readable ones once ``g`` is imported as ``ɡ``.
The SQL knows the inventory as a list of values and finds contexts with window functions instead of patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inventory as I
from .functions import notation as N
from .functions import text as X
from .operators import analysis, distance, find, graph, intervals, rewrite

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- input ------------------------------------------------------------------------------------------------------------


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out by number: a table of short rows is read by one task or a few, however long its patterns take."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, n): distinct lower-case words of all documents, imported, and how often they occur. Everything per word is done
    after this one shuffle, so it is done once for each distinct word."""
    # an inner explode would make the optimizer extract all words twice, once to see whether there are any
    text = _table(spark, sf_dir, "documents").select(F.explode_outer(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1)).alias("word"))
    counted = text.where("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    # patterns take long for few bytes, so the words are spread by number where sizes alone would put them into one task
    counted = counted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    return counted.select(X.from_wild(F.col("word"), ascii_only=True).alias("form"), "n")



# The letters by the public IPA chart, with what they devoice to, how X-SAMPA and Kirshenbaum write them where that
# isn't the letter itself, and how closed the tract is.
_LETTERS = """letters AS (SELECT unit, manner, manner = 'vowel' AS vowel, manner IN ('plosive', 'fricative') AS obstruent, voiced,
  CASE unit WHEN 'b' THEN 'p' WHEN 'd' THEN 't' WHEN 'ɡ' THEN 'k' WHEN 'v' THEN 'f' WHEN 'z' THEN 's' ELSE unit END AS devoiced,
  CASE unit WHEN 'ɡ' THEN 'g' WHEN 'r' THEN 'r<trl>' ELSE unit END AS kirshenbaum, CASE unit WHEN 'ɡ' THEN 'g' ELSE unit END AS xsampa,
  CASE WHEN manner IN ('plosive', 'nasal') THEN 1.0 WHEN manner = 'trill' THEN 0.9 WHEN manner = 'fricative' THEN 0.8 WHEN manner = 'approximant' THEN 0.6
    WHEN unit IN ('i', 'u', 'y') THEN 0.4 WHEN unit IN ('e', 'o') THEN 0.27 ELSE 0.0 END AS closed
  FROM (SELECT unnest(string_split('aeiouy', '')) AS unit, 'vowel' AS manner, true AS voiced UNION ALL SELECT unnest(string_split('bdɡ', '')), 'plosive', true
  UNION ALL SELECT unnest(string_split('ptkcq', '')), 'plosive', false UNION ALL SELECT unnest(string_split('vz', '')), 'fricative', true
  UNION ALL SELECT unnest(string_split('fshx', '')), 'fricative', false UNION ALL SELECT unnest(string_split('mn', '')), 'nasal', true
  UNION ALL SELECT unnest(string_split('jlw', '')), 'approximant', true UNION ALL SELECT 'r', 'trill', true))"""
_WORDS = "words AS (SELECT replace(word, 'g', 'ɡ') AS form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents) GROUP BY 1)"
_UNITS = (
    "units AS (SELECT form, n, unit, pos, len, lag(unit) OVER w AS before, lead(unit) OVER w AS after FROM (SELECT form, n, length(form) AS len, unnest(string_split(form, '')) AS unit, "
    "unnest(range(length(form))) AS pos FROM words) WINDOW w AS (PARTITION BY form ORDER BY pos))"
)
_HEAD = f"WITH {_LETTERS}, {_WORDS}, {_UNITS} "


# -- scans and tokens -------------------------------------------------------------------------------------------------


@query(_HEAD + "SELECT unit, CAST(sum(n) AS BIGINT) AS n FROM units GROUP BY unit")
def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).select(F.explode_outer(X.units(F.col("form"))).alias("unit"), "n").where("unit is not null")
    return w.groupBy("unit").agg(F.sum("n").alias("n"))


@query(_HEAD + "SELECT form, n, CAST(length(form) AS BIGINT) AS n_units, array_to_string(string_split(form, ''), ' ') AS segmented FROM words")
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("form", "n", F.size(X.units(F.col("form"))).cast("long").alias("n_units"), X.segmented(F.col("form")).alias("segmented"))


@query("SELECT p_partkey, replace(p_name, 'g', 'ɡ') AS form FROM part")
def wild_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", X.from_wild(F.col("p_name"), ascii_only=True).alias("form"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(translate(c_name, ':?''', 'xxx'), '[A-Z0-9]') THEN 'unknown_symbol' ELSE '' END AS codes FROM customer")
def validate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = X.from_wild(F.lower("c_name"), ascii_only=True)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(X.findings(form), "|").alias("codes"))


@query()
def accented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with accents: canonical decomposition, then units and what is lost."""
    text = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{Ll}*[^\x00-\x7F]\p{Ll}*)"), 1)).alias("word"))
    w = text.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", X.from_wild(F.col("word")).alias("form"))
    return w.select("word", "n", "form", F.size(X.units(F.col("form"))).alias("n_units"), F.array_join(X.lost(F.col("form")), "").alias("lost"))


# -- feature and structural queries -----------------------------------------------------------------------------------


@query(_HEAD + "SELECT u.form, CAST(u.pos AS BIGINT) AS pos, u.unit FROM units u JOIN letters l USING (unit) WHERE l.vowel")
def find_vowels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(words(spark, sf_dir).select("form"), "form", "[vowel]", plain=True)


@query(_HEAD + "SELECT u.form, CAST(u.pos AS BIGINT) AS pos, u.unit FROM units u JOIN letters l USING (unit) WHERE NOT l.obstruent AND l.voiced")
def find_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(words(spark, sf_dir).select("form"), "form", "[-obstruent +voiced]", plain=True)


_BETWEEN = "JOIN letters l USING (unit) JOIN letters b ON b.unit = u.before JOIN letters a ON a.unit = u.after WHERE l.obstruent AND b.vowel AND a.vowel"


@query(_HEAD + f"SELECT u.unit, count(*) AS words, CAST(sum(u.n) AS BIGINT) AS n FROM units u {_BETWEEN} GROUP BY u.unit")
def feature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: obstruents between vowels, counted by unit."""
    hits = find.find(words(spark, sf_dir), "form", "[obstruent] / [vowel] _ [vowel]", plain=True)
    return hits.groupBy("unit").agg(F.count("*").alias("words"), F.sum("n").alias("n"))


@query(_HEAD + f"SELECT u.form, CAST(u.pos AS BIGINT) AS pos, u.unit FROM units u {_BETWEEN}")
def query_intervocalic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(words(spark, sf_dir).select("form"), "form", "[obstruent] / [vowel] _ [vowel]", plain=True)


@query(_HEAD + "SELECT u.form, CAST(u.pos AS BIGINT) AS pos, u.unit FROM units u JOIN letters l USING (unit) WHERE l.obstruent AND u.pos = u.len - 1")
def query_word_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(words(spark, sf_dir).select("form"), "form", "[obstruent] / _ #", plain=True)


@query(_HEAD + "SELECT u.form, CAST(u.pos AS BIGINT) AS pos, u.unit FROM units u JOIN letters l USING (unit) JOIN letters b ON b.unit = u.before WHERE l.manner = 'plosive' AND b.manner = 'plosive' AND l.voiced = b.voiced")
def query_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plosives after a plosive of the same voicing."""
    return find.find(words(spark, sf_dir).select("form"), "form", "[plosive voiced=α] / [plosive voiced=α] _", plain=True)


@query(
    _HEAD
    + "SELECT u.form, CAST(u.pos AS BIGINT) AS pos, u.unit FROM units u JOIN letters l USING (unit) WHERE u.unit = 't' AND u.pos >= 1 AND EXISTS (SELECT 1 FROM range(1, 4) r(k) "
    "WHERE u.pos - k >= 0 AND substr(u.form, u.pos - k + 1, 1) = 's' AND regexp_full_match(substr(u.form, u.pos - k + 2, k - 1), '[aeiouy]*'))"
)
def query_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t after s and up to two vowels."""
    return find.find(words(spark, sf_dir).select("form"), "form", "t / s ([vowel]){0,2} _", plain=True)


# -- rewriting --------------------------------------------------------------------------------------------------------

_FINAL = "CASE WHEN l.obstruent THEN left(form, length(form) - 1) || l.devoiced ELSE form END"
_DEVOICE = "[obstruent +voiced] -> [-voiced] / _ #"


@query(_HEAD + f"SELECT form, {_FINAL} AS surface FROM words JOIN letters l ON l.unit = right(form, 1)")
def rewrite_final_devoicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("form", rewrite.rewrite(F.col("form"), _DEVOICE, plain=True).alias("surface"))


@query(
    _HEAD + "SELECT form, string_agg(CASE WHEN u.unit IN ('t', 'd') AND b.vowel AND a.vowel THEN 'ɾ' ELSE u.unit END, '' ORDER BY pos) AS surface "
    "FROM units u LEFT JOIN letters b ON b.unit = u.before LEFT JOIN letters a ON a.unit = u.after GROUP BY form"
)
def rewrite_flapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("form", rewrite.rewrite(F.col("form"), rewrite.shipped("flapping"), plain=True).alias("surface"))


_CASCADE = "t -> s / _ i ; assibilation\n[obstruent +voiced] -> [-voiced] / _ # ; final devoicing\n∅ -> e / # _ s ; prothesis"


@query(
    _HEAD
    + """, one AS (SELECT form, replace(form, 'ti', 'si') AS s1 FROM words), two AS (SELECT form, s1, CASE WHEN l.obstruent THEN left(s1, length(s1) - 1) || l.devoiced ELSE s1 END AS s2 FROM one JOIN letters l ON l.unit = right(s1, 1)),
    three AS (SELECT form, s1, s2, CASE WHEN left(s2, 1) = 's' THEN 'e' || s2 ELSE s2 END AS s3 FROM two)
    SELECT rule, count(*) AS n FROM (SELECT 'assibilation' AS rule FROM three WHERE s1 <> form UNION ALL SELECT 'final devoicing' FROM three WHERE s2 <> s1 UNION ALL SELECT 'prothesis' FROM three WHERE s3 <> s2) GROUP BY rule"""
)
def rewrite_trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rewrite.derive(words(spark, sf_dir), "form", _CASCADE, plain=True)
    return d.select(F.explode_outer("trace").alias("step")).where("step is not null").groupBy(F.col("step.name").alias("rule")).agg(F.count("*").alias("n"))


_OPTIONAL = "[obstruent +voiced] ~> [-voiced] / _ # ; devoicing\nt ~> s / _ i ; assibilation"


@query(
    _HEAD + "SELECT form, CAST((CASE WHEN l.obstruent AND l.devoiced <> l.unit THEN 2 ELSE 1 END) * power(2, (length(form) - length(replace(form, 'ti', ''))) / 2) AS BIGINT) AS n_variants FROM words JOIN letters l ON l.unit = right(form, 1)"
)
def variants_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rewrite.variants(words(spark, sf_dir), "form", _OPTIONAL, plain=True)
    return v.select("form", F.size("variants").cast("long").alias("n_variants"))


@query(
    _HEAD
    + """SELECT CASE WHEN contains(form, 'ti') THEN CASE WHEN length(form) % 3 = 0 THEN 'refused' ELSE 'derived' END WHEN length(form) % 2 = 0 THEN 'unchanged' ELSE 'refused' END AS class, count(*) AS n
    FROM words GROUP BY 1"""
)
def experiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with ti against themselves with the first ti as si (and with an x, where their length is a multiple of 3), others against
    themselves or with an x: how an optional rule relates them, which may rewrite each of its sites or not."""
    w = words(spark, sf_dir)
    first = F.regexp_replace("form", "^(.*?)ti", "$1si")
    ti = F.col("form").contains("ti")
    target = F.when(ti & (F.length("form") % 3 == 0), F.concat(first, F.lit("x"))).when(ti, first).when(F.length("form") % 2 == 0, F.col("form")).otherwise(F.concat("form", F.lit("x")))
    return rewrite.experiment(w.withColumn("target", target), "form", "target", "t ~> s / _ i").groupBy("class").agg(F.count("*").alias("n"))


# -- notation ---------------------------------------------------------------------------------------------------------


@query(_HEAD + "SELECT form, string_agg(l.kirshenbaum, '' ORDER BY pos) AS ascii FROM units JOIN letters l USING (unit) GROUP BY form")
def to_kirshenbaum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("form", N.to_kirshenbaum(F.col("form")).alias("ascii"))


@query(_HEAD + "SELECT form, string_agg(l.xsampa, '' ORDER BY pos) AS ascii FROM units JOIN letters l USING (unit) GROUP BY form")
def to_xsampa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("form", N.to_xsampa(F.col("form")).alias("ascii"))


# The letters that TIMIT has.
_TIMIT = "(VALUES ('i', 'iy'), ('u', 'uw'), ('j', 'y'), ('w', 'w'), ('l', 'l'), ('m', 'm'), ('n', 'n'), ('f', 'f'), ('v', 'v'), ('s', 's'), ('z', 'z'), ('h', 'hh'), ('p', 'p'), ('b', 'b'), ('t', 't'), ('d', 'd'), ('k', 'k'), ('ɡ', 'g')) AS t(unit, target)"


@query(_HEAD + f"SELECT form, coalesce(string_agg(t.target, ' ' ORDER BY pos), '') AS symbols FROM units LEFT JOIN {_TIMIT} USING (unit) GROUP BY form")
def to_timit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("form", F.array_join(N.to_timit(F.col("form")), " ").alias("symbols"))


@query()
def cmu_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmu = N.to_cmu(F.col("form"))
    return words(spark, sf_dir).select("form", F.array_join(cmu, " ").alias("cmu"), N.from_cmu(cmu).alias("back"))


_VOCABULARY = ["th", "t", "h", "e", "r", "er", "an", "a", "n", "d", "i", "on", "in"]


@query(
    _HEAD
    + f", v AS (SELECT form, regexp_extract_all(form, '{'|'.join(sorted(_VOCABULARY, key=lambda x: (-len(x), x)))}') AS atoms FROM words) SELECT form, array_to_string(atoms, '|') AS atoms, CAST(length(form) - length(array_to_string(atoms, '')) AS BIGINT) AS n_residue FROM v"
)
def vocabulary_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = words(spark, sf_dir).select("form", N.vocabulary_tokenize(F.col("form"), _VOCABULARY).alias("v"))
    return v.select("form", F.array_join("v.atoms", "|").alias("atoms"), F.length("v.residue").cast("long").alias("n_residue"))


# -- distance of words ------------------------------------------------------------------------------------------------


@query()
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct word of the part names against each other one: sixteen words, whatever the scale."""
    w = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select(X.from_wild(F.col("w"), ascii_only=True).alias("w"))
    pairs = w.select(F.col("w").alias("a")).join(w.select(F.col("w").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(distance.word_similarity(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(distance.word_distance(F.col("a"), F.col("b"), False), 6).alias("unweighted"), F.round(distance.coverage(F.col("a"), F.col("b")), 6).alias("coverage"))


@query()
def rank_pronunciations(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = spark.createDataFrame([("ðə", 0), ("ænd", 1), ("ɪn", 2), ("ɔɹ", 3)], "accepted string, ordinal int")
    return distance.rank_pronunciations(words(spark, sf_dir).select("form"), "form", accepted, "accepted")


# -- intervals, graphs, relational shapes -----------------------------------------------------------------------------


@query(_HEAD + "SELECT form, CAST(count(*) FILTER (l.vowel) + count(*) FILTER (l.manner = 'nasal' AND NOT coalesce(a.vowel, false)) AS BIGINT) AS morae FROM units u JOIN letters l USING (unit) LEFT JOIN letters a ON a.unit = u.after GROUP BY form")
def mora_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("form", intervals.mora_count(F.col("form")).alias("morae"))


@query(
    _HEAD
    + """, nuclei AS (SELECT form, pos, lead(pos) OVER (PARTITION BY form ORDER BY pos) AS nxt FROM units JOIN letters l USING (unit) WHERE l.vowel),
    breaks AS (SELECT form, CASE WHEN nxt - pos = 1 THEN nxt
      WHEN nxt - pos > 2 AND p.obstruent AND (q.manner IN ('tap', 'trill') OR q.unit IN ('l')) THEN nxt - 2 ELSE nxt - 1 END AS b
      FROM nuclei LEFT JOIN letters p ON p.unit = substr(form, nxt - 1, 1) LEFT JOIN letters q ON q.unit = substr(form, nxt, 1) WHERE nxt IS NOT NULL)
    SELECT u.form, string_agg(CASE WHEN b.b IS NULL THEN u.unit ELSE '.' || u.unit END, '' ORDER BY u.pos) AS syllables FROM units u LEFT JOIN breaks b ON b.form = u.form AND b.b = u.pos GROUP BY u.form"""
)
def syllabify_spanish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("form", F.array_join(intervals.syllabify(F.col("form")), ".").alias("syllables"))


@query(
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, epoch_us(ts) AS s, max(epoch_us(ts) + (1 + event_id % 50) * 3600000000) OVER (PARTITION BY user_id ORDER BY ts, event_id % 50, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM events) WHERE e > s"
)
def timed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken as intervals of 1 to 50 hours: those that begin before an earlier one of the same user ends."""
    start, duration = F.expr("unix_micros(cast(ts as timestamp))"), (1 + F.col("event_id") % 50) * F.lit(3_600_000_000)
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", start.alias("start"), duration.alias("duration"))
    return intervals.timed_overlaps(e, "user_id", "start", "duration", "event_id").select("user_id", "event_id")


@query(
    "SELECT 'r' || n_regionkey AS root, CAST(1 AS INTEGER) AS depth, count(*) AS n FROM nation GROUP BY ALL UNION ALL "
    "SELECT 'r' || n_regionkey, 2, count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL"
)
def graph_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions contain nations, which contain suppliers."""
    n, s = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    edge = lambda df, a, x, b, y: df.select(F.lit(1).alias("graph"), F.lit("contains").alias("name"), F.concat(F.lit(a), x).alias("src"), F.lit(0).alias("ordinal"), F.concat(F.lit(b), y).alias("tgt"))
    rel = edge(n, "r", F.col("n_regionkey"), "n", F.col("n_nationkey")).unionAll(edge(s, "n", F.col("s_nationkey"), "s", F.col("s_suppkey")))
    roots = n.select(F.lit(1).alias("graph"), F.concat(F.lit("r"), "n_regionkey").alias("root")).distinct()
    return graph.descendants(rel, roots).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(
    f"WITH {_LETTERS}, p AS (SELECT p_brand, p_type, unnest(string_split(replace(p_name, 'g', 'ɡ'), '')) AS unit FROM part) "
    "SELECT p_brand, p_type, count(*) AS n_units, count(*) FILTER (obstruent) AS n_obstruents FROM p JOIN letters USING (unit) GROUP BY ROLLUP (p_brand, p_type)"
)
def obstruents_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relational shape with a phonetic measure: obstruents in part names by brand and type, rolled up."""
    form = X.from_wild(F.col("p_name"), ascii_only=True)
    p = spread(_table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name")).select("p_brand", "p_type", F.size(X.units(form)).cast("long").alias("u"), F.size(find.matching_units(form, "obstruent")).cast("long").alias("o"))
    return p.rollup("p_brand", "p_type").agg(F.sum("u").alias("n_units"), F.sum("o").alias("n_obstruents"))


@query(
    f"WITH {_LETTERS}, w AS (SELECT lang, unnest(string_split(replace(array_to_string(regexp_extract_all(text, '[a-z]+'), ''), 'g', 'ɡ'), '')) AS unit FROM documents) "
    "SELECT lang, manner, count(*) AS n FROM w JOIN letters USING (unit) GROUP BY lang, manner"
)
def manner_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by language first, so a word is taken apart once for each language; then units, then the join with the inventory."""
    w = _table(spark, sf_dir, "documents").select("lang", F.explode_outer(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1)).alias("word")).where("word is not null")
    w = w.groupBy("lang", "word").agg(F.count("*").alias("n"))
    u = w.select("lang", "n", F.explode_outer(F.split(X.from_wild(F.col("word"), ascii_only=True), "")).alias("unit")).groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    dim = analysis.feature_table(spark).where("feature = 'manner'").select(F.col("symbol").alias("unit"), F.col("value").alias("manner"))
    return u.join(F.broadcast(dim), "unit").groupBy("lang", "manner").agg(F.sum("n").alias("n"))


# -- comparison -------------------------------------------------------------------------------------------------------

_PART_WORDS = "w AS (SELECT DISTINCT unnest(string_split(replace(p_name, 'g', 'ɡ'), ' ')) AS w FROM part)"


@query(
    f"WITH {_LETTERS}, {_WORDS}, p AS (SELECT form, CASE WHEN l.obstruent THEN left(form, length(form) - 1) || l.devoiced ELSE form END AS other, l.devoiced <> l.unit AND l.obstruent AS moved FROM words JOIN letters l ON l.unit = right(form, 1)) "
    "SELECT right(form, 1) AS \"left\", right(other, 1) AS \"right\", 'FEATURE' AS kind, count(*) AS n FROM p WHERE moved GROUP BY ALL"
)
def disagreement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words against themselves with the last obstruent devoiced."""
    from .operators import compare

    w = words(spark, sf_dir).select("form", rewrite.rewrite(F.col("form"), _DEVOICE, plain=True).alias("other"))
    return compare.disagreements(w.where("form <> other"), ["form"], "form", "other").groupBy("left", "right", "kind").agg(F.count("*").alias("n"))


@query(
    "SELECT p_partkey, CAST(1 + len(string_split(p_name, ' ')) * 2 - 1 + length(replace(p_name, ' ', '')) AS BIGINT) AS n_relations FROM part"
)
def form_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as trees of words, of one syllable each as none is marked, and segments."""
    from .operators import compare

    p = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", X.from_wild(F.col("p_name"), ascii_only=True).alias("form"))
    return compare.tree(p, "p_partkey", "form").groupBy(F.col("graph").cast("long").alias("p_partkey")).agg(F.count("*").alias("n_relations"))


@query(
    f"WITH {_LETTERS}, pts AS (SELECT unit, closed AS off FROM letters), {_PART_WORDS}, "
    "u AS (SELECT w, CAST(off AS DOUBLE) AS off, lead(CAST(off AS DOUBLE)) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM (SELECT w, unnest(string_split(w, '')) AS unit, unnest(range(length(w))) AS pos FROM w) JOIN pts USING (unit)) "
    "SELECT w, count(*) AS frames, round(sum(off * (1 - t) + coalesce(nxt, off) * t), 6) AS total FROM (SELECT *, unnest(CASE WHEN nxt IS NULL THEN [0.0] ELSE [0.0, 0.25, 0.5, 0.75] END) AS t FROM u) GROUP BY w"
)
def trajectory_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import compare

    w = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select(X.from_wild(F.col("w"), ascii_only=True).alias("w"))
    return compare.trajectory(w, "w").groupBy("w").agg(F.count("*").alias("frames"), F.round(F.sum("offset"), 6).alias("total"))


@query(
    f"WITH {_LETTERS}, {_PART_WORDS} SELECT a.w AS a, b.w AS b, 2 * least(length(a.w), length(b.w)) >= 1.8 * (length(a.w) + length(b.w)) / 2 AS possible FROM w a JOIN w b ON a.w < b.w"
)
def length_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part words that a similarity of 0.9 could hold for, by their lengths."""
    w = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select(X.from_wild(F.col("w"), ascii_only=True).alias("w"))
    n, m = F.size(X.units(F.col("a"))), F.size(X.units(F.col("b")))
    return w.select(F.col("w").alias("a")).join(w.select(F.col("w").alias("b")), F.col("a") < F.col("b")).select("a", "b", (2 * F.least(n, m) >= 0.9 * (n + m)).alias("possible"))


@query("SELECT doc_id, 'form' AS type, CAST(len(regexp_extract_all(text, '[a-z]')) AS BIGINT) AS n_units FROM documents")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower-case letters of whole documents as forms, through the wire format and back."""
    from .functions import segments

    form = X.from_wild(F.regexp_replace("text", "[^a-z]+", ""), ascii_only=True)
    back = segments.form_from_json(segments.form_to_json(form))
    return _table(spark, sf_dir, "documents").select("doc_id", back.alias("x")).select("doc_id", F.col("x.type").alias("type"), F.size("x.units").cast("long").alias("n_units"))


from . import workload_structures  # noqa: E402, F401  registers its queries
from . import workload_forms, workload_tables  # noqa: E402, F401, I001  register their queries
