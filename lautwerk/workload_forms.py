"""Queries over marked notation, unbounded contexts, tiers, licensed syllables, graph orders and choices, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import notation as N
from .functions import segments
from .functions import text as X
from .operators import find, order, syllables
from .workload import _HEAD, _WORDS, _table, query, spread, words
from .workload_structures import _SQL, _edges, tied

# A marked unit for each letter, how X-SAMPA and Kirshenbaum write it by the published tables, and what the latter can't.
_MARKED = """marked(letter, unit, xsampa, kirshenbaum, lost) AS (VALUES ('a', 'ã', 'a~', 'a~', ''), ('b', 'b̥', 'b_0', 'b', '̥'), ('c', 't͡ʃ', 't_S', 'tS', ''), ('d', 'd̪', 'd_d', 'd', '̪'), ('e', 'eː', 'e:', 'e:', ''),
 ('f', 'f', 'f', 'f', ''), ('ɡ', 'ɡʷ', 'g_w', 'g', 'ʷ'), ('h', 'ħ', 'X\\', 'H', ''), ('i', 'i̯', 'i_^', 'i', '̯'), ('j', 'd͡ʒ', 'd_Z', 'dZ', ''), ('k', 'kʰ', 'k_h', 'k[h]', ''), ('l', 'l̩', 'l=', 'l=', ''),
 ('m', 'm̩', 'm=', 'm=', ''), ('n', 'n̥', 'n_0', 'n', '̥'), ('o', 'o͜ʊ', 'o_U', 'oU', '͜'), ('p', 'pʰ', 'p_h', 'p[h]', ''), ('q', 'qʼ', 'q_>', 'q', 'ʼ'), ('r', 'ɹ̩', 'r\\=', 'r=', ''), ('s', 's̻', 's_m', 's', '̻'),
 ('t', 'tʰ', 't_h', 't[h]', ''), ('u', 'u˥', 'u_T', 'u', '˥'), ('v', 'v̬', 'v_v', 'v', '̬'), ('w', 'w', 'w', 'w', ''), ('x', 'k͡p', 'k_p', 'kp', '͡'), ('y', 'ʏ̆', 'Y_X', 'I.', '̆'), ('z', 'z̺', 'z_a', 'z', '̺'))"""
_SPELLED = {"a": "ã", "b": "b̥", "c": "t͡ʃ", "d": "d̪", "e": "eː", "ɡ": "ɡʷ", "h": "ħ", "i": "i̯", "j": "d͡ʒ", "k": "kʰ", "l": "l̩", "m": "m̩", "n": "n̥", "o": "o͜ʊ", "p": "pʰ", "q": "qʼ", "r": "ɹ̩", "s": "s̻", "t": "tʰ", "u": "u˥", "v": "v̬", "x": "k͡p", "y": "ʏ̆", "z": "z̺"}
_LETTERWISE = f"WITH {_MARKED}, {_WORDS}, l AS (SELECT form, unnest(string_split(form, '')) AS letter, unnest(range(length(form))) AS pos FROM words) "


def marked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, marked): distinct words, and the same with a marked unit for each letter, stressed."""
    m = F.create_map(*(F.lit(x) for kv in _SPELLED.items() for x in kv))
    spelled = F.array_join(F.transform(F.split("form", ""), lambda c: F.coalesce(F.try_element_at(m, c), c)), "")
    return words(spark, sf_dir).select("form", F.concat(F.lit("ˈ"), spelled).alias("marked"))


@query(_LETTERWISE + "SELECT form, '\"' || string_agg(xsampa, '' ORDER BY pos) AS ascii, 'ˈ' || string_agg(unit, '' ORDER BY pos) AS back, 0 AS n_lost FROM l JOIN marked USING (letter) GROUP BY form")
def marked_xsampa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks, ties and stress in X-SAMPA, there and back."""
    w = marked_words(spark, sf_dir).select("form", "marked", N.to_xsampa(F.col("marked")).alias("ascii"))
    return w.select("form", "ascii", N.from_xsampa(F.col("ascii")).alias("back"), F.size(N.losses_to(F.col("marked"), "xsampa")).alias("n_lost"))


@query(_LETTERWISE + "SELECT form, '''' || string_agg(kirshenbaum, '' ORDER BY pos) AS ascii, coalesce(string_agg(lost, '' ORDER BY pos), '') AS lost FROM l JOIN marked USING (letter) GROUP BY form")
def marked_kirshenbaum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in Kirshenbaum's notation, with what it can't carry."""
    w = marked_words(spark, sf_dir)
    return w.select("form", N.to_kirshenbaum(F.col("marked")).alias("ascii"), F.array_join(N.losses_to(F.col("marked"), "kirshenbaum"), "").alias("lost"))


@query(_LETTERWISE + "SELECT form, 'ˈ' || replace(string_agg(CASE letter WHEN 'c' THEN 't͡ʃ' WHEN 'j' THEN 'd͡ʒ' WHEN 'r' THEN 'ɹ̩' ELSE replace(CASE WHEN lost <> '' AND letter <> 'o' THEN replace(unit, lost, '') WHEN letter = 'o' THEN 'oʊ' WHEN letter = 'x' THEN 'kp' ELSE unit END, '͡', '') END, '' ORDER BY pos), 'dz', 'd͡z') AS back FROM l JOIN marked USING (letter) GROUP BY form")
def kirshenbaum_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back, without what the notation couldn't carry. It writes d and z as it writes their affricate."""
    return marked_words(spark, sf_dir).select("form", N.from_kirshenbaum(N.to_kirshenbaum(F.col("marked"))).alias("back"))


_QZ = "p AS (SELECT doc_id, i, substr(t, i, 1) AS c FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT doc_id, regexp_replace(text, '[^a-z]', '', 'g') AS t FROM documents)) WHERE substr(t, i, 1) IN ('q', 'z'))"


@query(
    f"WITH {_QZ}, d AS (SELECT doc_id, c, i - max(CASE WHEN c = 'q' THEN i END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS span FROM p) "
    "SELECT x.doc_id, count(span) FILTER (c = 'z') AS n_after, count(*) FILTER (c = 'z' AND span >= 200) AS n_far FROM documents x LEFT JOIN d USING (doc_id) GROUP BY x.doc_id"
)
def long_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of whole documents as one form: z after q and any number of units that aren't uvular, and after 200 of them at least."""
    form = X.from_wild(F.regexp_replace("text", "[^a-z]", ""), ascii_only=True)
    d = _table(spark, sf_dir, "documents").select("doc_id", form.alias("form"))
    with X.plain():
        after, far = (find.count(F.col("form"), f"z / q ([-uvular]){n} _") for n in ("*", "{200,}"))
    return d.select("doc_id", after.cast("long").alias("n_after"), far.cast("long").alias("n_far"))


@query(
    "WITH t AS (SELECT p_partkey, string_split(replace(p_name, 'g', 'ɡ'), ' ') AS w FROM part) "
    "SELECT p_partkey, CAST(len(list_filter(w, lambda x: regexp_matches(x, '[ptkbdɡcq]$'))) AS BIGINT) AS n_final, CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[ptkbdɡcq]'))) AS BIGINT) AS n_initial FROM t"
)
def word_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plosives at the ends and starts of intervals on the word tier, in part names."""
    p = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", X.from_wild(F.replace("p_name", F.lit(" "), F.lit("#")), ascii_only=True).alias("form"))
    p = p.withColumn("tiers", syllables.word_tier(F.col("form")))
    with X.plain():
        final, initial = (find.count(F.col("form"), spec, F.col("tiers")).cast("long") for spec in ("[plosive] / _ word>", "[plosive] / <word _"))
        return p.select("p_partkey", final.alias("n_final"), initial.alias("n_initial"))


_BREAKS = """, nuclei AS (SELECT form, pos, lead(pos) OVER (PARTITION BY form ORDER BY pos) AS nxt FROM units JOIN letters l USING (unit) WHERE l.vowel),
 breaks AS (SELECT form, CASE WHEN nxt - pos = 1 THEN nxt WHEN nxt - pos > 2 AND p.obstruent AND (q.manner IN ('tap', 'trill') OR q.unit IN ('l')) THEN nxt - 2 ELSE nxt - 1 END AS b
 FROM nuclei LEFT JOIN letters p ON p.unit = substr(form, nxt - 1, 1) LEFT JOIN letters q ON q.unit = substr(form, nxt, 1) WHERE nxt IS NOT NULL)"""


@query(_HEAD[:-1] + _BREAKS + " SELECT u.form, CAST(u.pos AS BIGINT) AS pos, u.unit FROM units u JOIN letters l USING (unit) JOIN breaks b ON b.form = u.form AND b.b = u.pos + 1 WHERE NOT l.vowel")
def syllable_codas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consonants at the end of a derived syllable, within words: the tier comes from the language, not from written breaks."""
    with X.plain():
        w = words(spark, sf_dir).select("form", syllables.tiers(F.col("form")).alias("tiers"))
        w = w.withColumn("tiers", F.filter("tiers", lambda t: t["tier"] == "syllable"))
        found = find.find(w, "form", "[-vowel] / _ syllable> <syllable", plain=True, tiers_col="tiers")
    return found.select("form", "pos", "unit")


_TOY = [("toy", "onset", 1, "[-vowel]", None), ("toy", "onset", 2, "[obstruent] [manner=trill]", None), ("toy", "onset", 3, "[obstruent] [channel=lateral]", None), ("toy", "onset", 4, "s [plosive]", "borrowing"), ("toy", "coda", 1, "[-vowel]", None), ("toy", "coda", 2, "[nasal] [plosive]", None), ("toy", "coda", 3, "[manner=trill] [-vowel]", None)]
_ONSET, _CODA = "([^aeiouy]|[bdɡptkcqvzfshx][rl]|s[bdɡptkcq])?", "([^aeiouy]|[mn][bdɡptkcq]|r[^aeiouy])?"


@query(
    f"WITH {_WORDS}, r AS (SELECT form, string_split_regex(form, '[aeiouy]') AS runs FROM words) SELECT form, CASE WHEN len(runs) < 2 OR NOT regexp_full_match(runs[1], '{_ONSET}') OR NOT regexp_full_match(runs[len(runs)], '{_CODA}') THEN 0 "
    f"ELSE CAST(coalesce(list_aggregate(list_transform(runs[2 : len(runs) - 1], lambda x: len(list_filter(range(length(x) + 1), lambda k: regexp_full_match(substr(x, 1, k), '{_CODA}') AND regexp_full_match(substr(x, k + 1), '{_ONSET}')))), 'product'), 1) AS BIGINT) END AS n_readings FROM r"
)
def syllable_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many ways the words can be divided by a language whose onsets and codas come from a table."""
    kind = "language string, kind string, ordinal int, span string, stratum string"
    toy = syllables.read_languages(spark.createDataFrame(_TOY, kind))["toy"]
    with X.plain():
        return words(spark, sf_dir).select("form", syllables.count_readings(F.col("form"), toy).alias("n_readings"))


@query(_SQL["tied_projection"])
def tied_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of units of two parts, as rows are given them."""
    at = lambda f: F.try_element_at("features", F.lit(f)).alias(f)
    out = segments.with_features(tied(spark, sf_dir).select("unit"), "unit")
    return out.select("unit", at("manner"), at("voiced"), *(F.when(stated, F.try_element_at("features", F.lit(f))).alias(f) for f, stated in _stated().items()))


def _stated() -> dict:
    """Features that have a default, and whether a unit of two letters states them: the SQL knows no defaults."""
    vowels = F.col("unit").rlike("[aeiouy]")
    fused = F.col("unit").contains("͡")
    first = lambda letters: F.col("unit").rlike(f"^[{letters}]")
    any_ = lambda letters: F.col("unit").rlike(f"[{letters}]")
    has = lambda letters: F.when(fused, any_(letters)).otherwise(first(letters))
    return {"rounded": has("aeiouy"), "channel": has("lsz"), "height": F.lit(True), "backness": F.lit(True), "place": vowels | ~vowels}


# -- graphs -----------------------------------------------------------------------------------------------------------


@query("SELECT 'k' || c_custkey AS node, (SELECT min('k' || c_custkey) FROM customer) AS component FROM customer")
def graph_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as one ring, with a chain of the same length that leaves it: the ring is one component, the chain none."""
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "customer").count()
    k = F.col("c_custkey")
    first = c.agg(F.min("c_custkey").alias("first"))
    ring = c.crossJoin(F.broadcast(first)).select(k, F.when(k == F.col("first") + n - 1, F.col("first")).otherwise(k + 1).alias("nxt"))
    edges = _edges(ring, 1, F.concat(F.lit("k"), k), F.concat(F.lit("k"), "nxt"))
    chain = _edges(c, 1, F.concat(F.lit("tail"), k), F.concat(F.lit("tail"), k + 1))
    start = _edges(first, 1, F.concat(F.lit("k"), "first"), F.concat(F.lit("tail"), "first"))
    return order.strong_components(edges.unionAll(chain).unionAll(start)).select("node", "component")


@query(
    "WITH l AS (SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY min(l_shipdate)) - 1 AS level FROM lineitem GROUP BY l_orderkey, l_linenumber) "
    "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(level AS INTEGER) AS level, row_number() OVER (PARTITION BY l_orderkey ORDER BY level, l_linenumber) - 1 AS place FROM l"
)
def line_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order, each before those that ship on the order's next day of shipping; levels, and ties by line number."""
    # dealt out by order once: lines, days and the next of them stay where they are
    l = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").repartition("l_orderkey")  # noqa: E741
    l = l.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"))  # noqa: E741
    days = l.groupBy("l_orderkey", "l_shipdate").agg(F.collect_list("l_linenumber").alias("lines"))
    nxt = days.select("l_orderkey", "lines", F.lead("lines").over(Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("l_shipdate"))).alias("later"))
    edges = nxt.where("later is not null").select("l_orderkey", F.explode("lines").alias("src"), "later").select("l_orderkey", "src", F.explode("later").alias("tgt"))
    name = lambda c: F.concat(F.lit("l"), c)
    edges = edges.select(F.col("l_orderkey").alias("graph"), name("src").alias("src"), name("tgt").alias("tgt"))
    clock = l.select(F.col("l_orderkey").alias("graph"), name("l_linenumber").alias("node"), F.col("l_linenumber").alias("clock"))
    out = order.scan_order(edges, clock)
    return out.select(F.col("graph").alias("l_orderkey"), F.substring("node", 2, 9).cast("int").alias("l_linenumber"), "level", "place")


@query(
    "WITH c AS (SELECT c_custkey AS k, c_custkey % 50 AS m FROM customer WHERE c_custkey < (SELECT max(c_custkey) // 50 * 50 FROM customer) AND c_custkey >= 50) "
    "SELECT 'c' || k AS node, CASE WHEN m BETWEEN 9 AND 19 OR m > 27 THEN 'c' || (k + CASE WHEN m = 9 THEN 0 WHEN m < 20 THEN 19 - m WHEN m < 30 THEN 29 - m WHEN m < 40 THEN 39 - m ELSE 49 - m END) END AS resolved, "
    "CASE WHEN m < 9 THEN 'cycle' WHEN m BETWEEN 20 AND 27 THEN 'dangling' ELSE 'resolved' END AS reason FROM c"
)
def choice_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that select the next one, in chains of ten; in every fifth chain of ten the choices run in a circle, or lead to nobody."""
    c = _table(spark, sf_dir, "customer")
    top = c.agg((F.floor(F.max("c_custkey") / 50) * 50).alias("top"))
    c = c.crossJoin(F.broadcast(top)).where("c_custkey >= 50 and c_custkey < top").select(F.col("c_custkey").alias("k"))
    m, name = F.col("k") % 50, lambda x: F.concat(F.lit("c"), x)
    to = F.when(m == 8, name(F.col("k") - 3)).when(m == 27, F.lit("nobody")).otherwise(name(F.col("k") + 1))
    rel = c.where((m == 8) | (F.col("k") % 10 != 9)).select(F.lit(1).alias("graph"), F.lit("selects").alias("name"), name(F.col("k")).alias("src"), F.lit(0).alias("ordinal"), to.alias("tgt"))
    nodes = c.select(F.lit(1).alias("graph"), name(F.col("k")).alias("node"))
    return order.resolve(rel, nodes, nodes).select("node", "resolved", "reason")
