"""A corpus of forms by role, with metadata, named splits and assets, as a log of changes over Parquet files; and dictionary readers.

A change writes files of its own below ``data`` and then one entry of the log, which lists the live files of all tables: rows
that are new, that replace those of the same entry, entries that are gone, or a whole table. Nothing that is there is
changed or moved, so a change is there with its entry, all tables at once, or not at all, wherever its writer stops; and readers
go on with the entry that they began with, or ask for any earlier one. Entries are made under numbers of their own, so of two
writers at once one is refused. Replaced rows are left out when a table is read; ``compact`` writes tables that have such anew.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

FORMS = "entry_id string, form string, producer string, version string, role string"
META = "entry_id string, meta string"
SPLITS = "entry_id string, ordinal long, split string"
ASSETS = "entry_id string, kind string, path string"
_SCHEMAS = {"forms": FORMS, "meta": META, "splits": SPLITS, "assets": ASSETS}
VERSION = "1"
#: What an entry's id looks like.
ID = "^[A-Za-z0-9][A-Za-z0-9._-]*$"


class CorpusError(ValueError):
    """A corpus that isn't as it should be."""


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@dataclass
class Corpus:
    spark: SparkSession
    path: str
    at: int | None = None  # number of the log entry to read; the last if None

    # -- log

    def _entries(self) -> list[int]:
        fs, p = _at(self.spark, f"{self.path}/log")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []

    def _state(self) -> tuple[int, dict[str, list[list[str]]]]:
        """Number of the last entry, and the live (folder, kind) of each table by the last one that was written to its end."""
        numbers = self._entries()
        for n in reversed([k for k in numbers if self.at is None or k <= self.at]):
            fs, p = _at(self.spark, f"{self.path}/log/{n:012d}")
            stream = fs.open(p)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):  # else its writer stopped before
                return numbers[-1], json.loads(text)
        return (numbers[-1] if numbers else 0), {}

    def _change(self, changes: list[tuple[str, DataFrame, str]], seen: int) -> None:
        """Write rows for tables, each as new, put, gone or all, and one entry for them after the one that was seen."""
        if self.at is not None:
            raise CorpusError("an earlier state of a corpus can't be changed")
        live = self._state()[1]
        for table, rows, kind in changes:
            folder = f"data/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            live[table] = [*([] if kind == "all" else live.get(table, [])), [folder, kind]]
        self._enter(seen + 1, live)

    def _enter(self, number: int, live: dict) -> None:
        fs, p = _at(self.spark, f"{self.path}/log/{number:012d}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise CorpusError("the corpus was changed meanwhile") from e
        out.writeBytes(json.dumps(live) + "\n")
        out.close()

    def as_of(self, number: int) -> Corpus:
        """The corpus as an entry of its log left it."""
        return Corpus(self.spark, self.path, number)

    def last_entry(self) -> int:
        return self._state()[0]

    def compact(self) -> None:
        """Write tables of several files, or with replaced rows, anew as one. Earlier states stay readable until vacuum."""
        seen, live = self._state()
        changes = [(t, self._merged(live[t], _SCHEMAS[t.split("/")[0]]), "all") for t, files in live.items() if len(files) > 1 or files[0][1] in ("put", "gone")]
        if changes:
            self._change(changes, seen)

    def vacuum(self) -> None:
        """Delete the files that the last entry doesn't list; earlier states can't be read any more."""
        kept = {folder for files in self._state()[1].values() for folder, _ in files}
        fs, p = _at(self.spark, f"{self.path}/data")
        for f in fs.listStatus(p) if fs.exists(p) else []:
            if f"data/{f.getPath().getName()}" not in kept:
                fs.delete(f.getPath(), True)

    # -- tables

    def _merged(self, files: list[list[str]], schema: str) -> DataFrame:
        """Rows of one table, or of several without replaced ones, that are live."""
        read = lambda folders, kind: self.spark.read.schema(kind).parquet(*(f"{self.path}/{f}" for f in folders))
        plain = [f for f, kind in files if kind in ("new", "all")]
        out = read(plain, schema) if plain else self.spark.createDataFrame([], schema)
        later = [(k, f, kind) for k, (f, kind) in enumerate(files) if kind in ("put", "gone")]
        if not later:
            return out
        rows = [read([f], schema).select(F.lit(k).alias("k"), F.lit(False).alias("is_gone"), F.struct("*").alias("r")) if kind == "put" else read([f], "entry_id string").select(F.lit(k).alias("k"), F.lit(True).alias("is_gone"), F.struct("entry_id", *(F.lit(None).cast(c.dataType).alias(c.name) for c in out.schema.fields[1:])).alias("r")) for k, f, kind in later]
        last = reduce(DataFrame.unionAll, rows).groupBy(F.col("r.entry_id").alias("id")).agg(F.max_by(F.struct("is_gone", "r"), "k").alias("x"))
        # what is new after an entry went is a row again
        order = {f: k for k, (f, _) in enumerate(files)}
        if any(order[f] > later[0][0] for f in plain):
            numbered = reduce(DataFrame.unionAll, [read([f], schema).withColumn("k", F.lit(order[f])) for f in plain])
            ends = reduce(DataFrame.unionAll, rows).groupBy(F.col("r.entry_id").alias("id")).agg(F.max("k").alias("end"))
            kept = numbered.join(ends, numbered["entry_id"] == ends["id"], "left").where("end is null or k > end").select(*out.columns)
            newer = kept.select(F.col("entry_id").alias("id")).distinct()
            last = last.join(newer, "id", "left_anti")
            return kept.unionAll(last.where("not x.is_gone").select("x.r.*"))
        return out.join(last.select(F.col("id").alias("entry_id")), "entry_id", "left_anti").select(*out.columns).unionAll(last.where("not x.is_gone").select("x.r.*"))

    def _read(self, name: str, schema: str, parts: tuple[str, ...] = ()) -> DataFrame:
        """A table; of forms and splits all parts, or those named. Parts without replaced rows are read as one."""
        live = self._state()[1]
        own = {t: files for t, files in live.items() if t.split("/", 1)[0] == name and (not parts or t.split("/", 1)[1] in parts)}
        simple = [f for files in own.values() if all(k in ("new", "all") for _, k in files) for f in files]
        merged = [self._merged(files, schema) for files in own.values() if not all(k in ("new", "all") for _, k in files)]
        return reduce(DataFrame.unionAll, [self._merged(simple, schema), *merged]) if simple or not merged else reduce(DataFrame.unionAll, merged)

    def _has(self, name: str) -> bool:
        return any(t == name or t.startswith(f"{name}/") for t in self._state()[1])

    def forms(self, *roles: str) -> DataFrame:
        """Forms of the roles named, or of all; roles have files of their own, so others aren't read."""
        return self._read("forms", FORMS, roles)

    def ids(self) -> DataFrame:
        return self._read("meta", META).select("entry_id").orderBy("entry_id")

    def roles(self) -> DataFrame:
        return self.forms().select("role").distinct()

    def read(self, entry_id: str, *roles: str) -> DataFrame:
        """Forms of one entry, of the roles named or of all."""
        return self.forms(*roles).where(F.col("entry_id") == entry_id)

    def read_all(self, ids: DataFrame, *roles: str) -> DataFrame:
        """Forms of many entries (entry_id) in one join."""
        return self.forms(*roles).join(ids.select("entry_id").distinct(), "entry_id", "left_semi")

    def count(self) -> int:
        return self._read("meta", META).count()

    def roles_of(self, entry_id: str) -> DataFrame:
        return self.read(entry_id).select("role").distinct()

    def add(self, entries: DataFrame, forms: dict[str, str] | None = None, producer: str = "", version: str = "") -> None:
        """Append entries (entry_id, meta), and forms by role from the columns named; refuses ids that are null, repeated, in the
        corpus or not made of letters, digits, dots, hyphens and underscores."""
        seen = self._state()[0]
        new = entries.select("entry_id", F.col("meta").cast("string").alias("meta"))
        ids = new.select("entry_id", F.lit(1).alias("n"))
        if self._has("meta"):  # an id that is there counts as one more
            ids = ids.unionAll(self._read("meta", META).join(new.select("entry_id"), "entry_id", "left_semi").select("entry_id", F.lit(1).alias("n")))
        if not ids.groupBy("entry_id").agg(F.sum("n").alias("n")).where(f"n > 1 or entry_id is null or not entry_id rlike '{ID}'").isEmpty():
            raise CorpusError("an id is null, repeated, in the corpus or no id")
        rows = [(f"forms/{role}", self._rows(entries.where(F.col(column).isNotNull()), column, producer, version, role), "new") for role, column in (forms or {}).items()]
        self._change([("meta", new, "new"), *rows], seen)

    @staticmethod
    def _rows(forms: DataFrame, column: str, producer: str, version: str, role: str) -> DataFrame:
        return forms.select("entry_id", F.col(column).alias("form"), F.lit(producer).alias("producer"), F.lit(version).alias("version"), F.lit(role).alias("role"))

    def put_forms(self, role: str, forms: DataFrame, producer: str, version: str) -> None:
        """Put forms (entry_id, form) into a role: those of entries that have one are replaced, the others stay. Refuses ids that the
        corpus doesn't have and ids that occur twice."""
        seen = self._state()[0]
        rows = self._rows(forms, "form", producer, version, role)
        known = self._read("meta", META).select("entry_id", F.lit(1).alias("known")).distinct()
        has = self._has(f"forms/{role}")
        old = self.forms(role).select("entry_id", F.lit(1).alias("old")).distinct()
        flags = rows.groupBy("entry_id").agg(F.count("*").alias("n")).join(known, "entry_id", "left")
        flags = flags.join(old, "entry_id", "left") if has else flags.withColumn("old", F.lit(None).cast("int"))
        r = flags.agg(F.max("n").alias("n"), F.count(F.when(F.col("known").isNull(), 1)).alias("strange"), F.count("old").alias("old")).first()
        if r["strange"] or (r["n"] or 0) > 1:
            raise CorpusError("a form's id isn't in the corpus, or occurs twice")
        self._change([(f"forms/{role}", rows, "put" if r["old"] else "new")], seen)

    def put_split(self, name: str, members: DataFrame) -> None:
        """A named split from members (ordinal, entry_id), each id once."""
        seen = self._state()[0]
        if not members.groupBy("entry_id").count().where("count > 1").isEmpty():
            raise CorpusError("a split holds an id twice")
        self._change([(f"splits/{name}", members.select("entry_id", F.col("ordinal").cast("long").alias("ordinal"), F.lit(name).alias("split")), "all")], seen)

    def split(self, name: str) -> DataFrame:
        """Members in order; refuses a split with ids that have left the corpus."""
        own = self._read("splits", SPLITS).where(F.col("split") == name)
        if not self.stale(name).isEmpty():
            raise CorpusError(f"split {name!r} has stale members")
        return own.select("ordinal", "entry_id").orderBy("ordinal")

    def stale(self, name: str) -> DataFrame:
        return self._read("splits", SPLITS).where(F.col("split") == name).join(self._read("meta", META), "entry_id", "left_anti").select("entry_id")

    def validate(self) -> DataFrame:
        """(entry_id, role, code) of everything that is wrong."""
        meta, forms = self._read("meta", META), self.forms()
        none = F.lit(None).cast("string")
        strange = meta.where(F.col("entry_id").isNull() | ~F.col("entry_id").rlike(ID)).select("entry_id", none.alias("role"), F.lit("invalid_id").alias("code"))
        empty = forms.where(F.col("form").isNull()).select("entry_id", "role", F.lit("forms").alias("code"))
        files = assets(self).select("entry_id", "kind").distinct()
        alien = files.join(meta, "entry_id", "left_anti").select("entry_id", F.col("kind").alias("role"), F.lit("orphan_asset").alias("code"))
        kinds = [r[0] for r in files.select("kind").distinct().collect()]  # a few names
        due = meta.select("entry_id", F.explode(F.array(*map(F.lit, kinds)).cast("array<string>")).alias("kind"))
        missing = due.join(files, ["entry_id", "kind"], "left_anti").select("entry_id", F.col("kind").alias("role"), F.lit("missing_asset").alias("code"))
        twice = meta.groupBy("entry_id").count().where("count > 1").select("entry_id", F.lit(None).cast("string").alias("role"), F.lit("duplicate_id").alias("code"))
        json_bad = meta.where(F.col("meta").isNotNull() & (F.try_parse_json("meta").isNull() | ~F.col("meta").rlike(r"^\s*\{"))).select("entry_id", F.lit(None).cast("string").alias("role"), F.lit("bad_meta").alias("code"))
        orphan = forms.join(meta, "entry_id", "left_anti").select("entry_id", "role", F.lit("orphan_form").alias("code"))
        invalid = forms.where(F.col("form").isNotNull()).select("entry_id", "role", F.explode(X.findings(F.col("form"))).alias("code"))
        return reduce(DataFrame.unionAll, [twice, json_bad, orphan, invalid, strange, empty, alien, missing])

    def fingerprint(self) -> str:
        """Digest of the forms whatever their order; equal forms count as often as they occur."""
        h = F.xxhash64("entry_id", "role", "form").cast("decimal(38,0)")
        r = self.forms().agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("s")).first()
        return f"{r['n']}:{r['s']}"


def create(spark: SparkSession, path: str, declaration: str | None = None) -> Corpus:
    fs, p = _at(spark, f"{path}/manifest")
    if fs.exists(p):
        raise CorpusError(f"{path} is a corpus already")
    spark.createDataFrame([(json.dumps({"type": "corpus", "v": VERSION, "declaration": declaration}),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return Corpus(spark, path)


def open_corpus(spark: SparkSession, path: str) -> Corpus:
    fs, p = _at(spark, f"{path}/manifest")
    if not fs.exists(p):
        raise CorpusError(f"{path} is no corpus")
    found = manifest(Corpus(spark, path))
    if (found.get("type"), found.get("v")) != ("corpus", VERSION):
        raise CorpusError(f"{path} has another type or version")
    return Corpus(spark, path)


def manifest(corpus: Corpus) -> dict:
    return json.loads(corpus.spark.read.text(f"{corpus.path}/manifest").first()[0])


# -- dictionaries -----------------------------------------------------------------------------------------------------


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): lines with their numbers from 1 within each file. Lines are numbered within the blocks that tasks read, and
    blocks by the counts of those before them, so a file may be larger than any task."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    own = lines.withColumn("within", F.row_number().over(Window.partitionBy("file", "block").orderBy(F.monotonically_increasing_id())))
    sizes = lines.groupBy("file", "block").count()
    before = sizes.select("file", "block", F.coalesce(F.sum("count").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return own.join(before, ["file", "block"]).select("value", (F.col("within") + F.col("before")).alias("line"))


def ingest_cmudict(corpus: Corpus, path: str, role: str = "cited") -> DataFrame:
    """Entries of a pronouncing dictionary put into a corpus, named by word and variant, in IPA; (line, word, reason) of the lines
    that are refused."""
    from ..functions.notation import from_cmu

    rows = read_cmudict(corpus.spark, path)
    good = rows.where("reason is null").withColumn("form", from_cmu(F.col("phones")))
    name = F.concat(F.regexp_replace(F.lower("word"), "[^a-z0-9._-]", "_"), F.lit("."), "variant", F.lit("."), "line")
    corpus.add(good.select(name.alias("entry_id"), F.to_json(F.struct("word", "variant", "line")).alias("meta"), "form"), {role: "form"}, "cmudict", VERSION)
    return rows.where("reason is not null").select("line", "word", "reason")


def emit_mfa_dict(df: DataFrame) -> DataFrame:
    """Lines ``word<TAB>phones`` from (word, phones)."""
    return df.select(F.concat_ws("\t", "word", F.array_join("phones", " ")).alias("value"))


def read_cmudict(spark: SparkSession, path: str) -> DataFrame:
    """(word, variant, phones, line, reason): lines of a pronouncing dictionary; reason names symbols that are none."""
    from ..functions.notation import inverse

    lines = numbered(spark, path).where(~F.col("value").rlike(r"^\s*(;;;|#|$)"))
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+#.*$", "")), r"\s+")
    head = F.element_at(parts, 1)
    phones = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.filter(phones, lambda s: ~F.regexp_replace(s, "[012]$", "").isin(*inverse("cmu+")))
    variant = F.coalesce(F.regexp_extract(head, r"\((\d+)\)$", 1).try_cast("int"), F.lit(1))
    reason = F.when(F.size(phones) == 0, "no phones").when(F.size(bad) > 0, F.concat(F.lit("unknown: "), F.array_join(bad, " ")))
    return lines.select(F.regexp_replace(head, r"\(\d+\)$", "").alias("word"), variant.alias("variant"), phones.alias("phones"), "line", reason.alias("reason"))


def read_ipa_dict(spark: SparkSession, path: str) -> DataFrame:
    """(word, variants, line, reason): ``word<TAB>/p/, /p2/``; a line is good when all its variants are."""
    lines = numbered(spark, path).where("trim(value) <> ''")
    parts = F.split("value", "\t", 2)
    variants = F.transform(F.split(F.element_at(parts, 2), r",\s*"), lambda v: F.regexp_replace(v, r"^/|/$", ""))
    bad = F.filter(variants, lambda v: ~X.is_valid(v))
    reason = F.when(F.size(parts) < 2, "no pronunciation").when(F.size(bad) > 0, F.concat(F.lit("invalid: "), F.array_join(bad, ", ")))
    return lines.select(F.element_at(parts, 1).alias("word"), variants.alias("variants"), "line", reason.alias("reason"))


def emit_ipa_dict(df: DataFrame) -> DataFrame:
    """Lines of the same format from (word, variants)."""
    return df.select(F.concat_ws("\t", "word", F.array_join(F.transform("variants", lambda v: F.concat(F.lit("/"), v, F.lit("/"))), ", ")).alias("value"))


def read_mfa_dict(spark: SparkSession, path: str) -> DataFrame:
    """(word, phones, line): ``word<TAB or space>phones``."""
    parts = F.split(F.trim("value"), r"\s+")
    return numbered(spark, path).where("trim(value) <> ''").select(F.element_at(parts, 1).alias("word"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("phones"), "line")


def read_phoible(spark: SparkSession, path: str, language: str | None = None, inventory: int | None = None) -> DataFrame:
    """Segments of a CSV of inventories, with their features' validity; filters reach the scan."""
    df = spark.read.option("header", True).csv(path)
    if language:
        df = df.where((F.col("ISO6393") == language) | (F.col("Glottocode") == language))
    if inventory is not None:
        df = df.where(F.col("InventoryID") == str(inventory))
    return df.select("InventoryID", "LanguageName", F.col("Phoneme").alias("phoneme"), F.split("Allophones", r"\s+").alias("allophones"), (F.col("Marginal") == "TRUE").alias("marginal"), X.findings(F.col("Phoneme")).alias("findings"))


def remove(corpus: Corpus, ids: DataFrame) -> Corpus:
    """The corpus without some entries: their forms and assets go, and they leave the splits, whose other members keep their
    ordinals; all in one change."""
    seen, live = corpus._state()
    gone = ids.select("entry_id").distinct()
    corpus._change([(table, gone, "gone") for table in live], seen)
    return corpus


def put_assets(corpus: Corpus, assets: DataFrame, check: bool = True) -> None:
    """Named files of entries (entry_id, kind, path); refuses ids that the corpus doesn't have, unless that is left to validate."""
    seen = corpus._state()[0]
    if check and not assets.join(corpus._read("meta", META), "entry_id", "left_anti").isEmpty():
        raise CorpusError("an asset's id isn't in the corpus")
    corpus._change([("assets", assets.select("entry_id", "kind", "path"), "new")], seen)


def assets(corpus: Corpus) -> DataFrame:
    return corpus._read("assets", ASSETS)


def asset_kinds(corpus: Corpus) -> DataFrame:
    return assets(corpus).groupBy("kind").agg(F.count("*").alias("n"))


def phoible_sources(segments: DataFrame, bibliography: DataFrame) -> DataFrame:
    """segments with bibtex_key and source of their inventory, from a map (InventoryID, BibtexKey, Source); null where it has none."""
    own = bibliography.groupBy("InventoryID").agg(F.min("BibtexKey").alias("bibtex_key"), F.min("Source").alias("source"))
    return segments.join(own, "InventoryID", "left")


def phoible_audit(segments: DataFrame) -> DataFrame:
    """(InventoryID, n, accepted, reason): how many segments of each inventory can be read, and why others can't."""
    reason = F.coalesce(F.array_join("findings", "+"), F.lit(""))
    return segments.groupBy("InventoryID", reason.alias("reason")).agg(F.count("*").alias("n")).withColumn("accepted", F.col("reason") == "")
