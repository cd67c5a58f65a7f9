"""Forced alignments and distance matrices from files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distance as D

ALIGNMENT = "frame_rate int, words array<struct<word:string,start:int,duration:int,phones array<struct<phone:string,start:int,duration:int>>>>".replace("phones array", "phones:array")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(file, word, phone, start, duration) in seconds from JSON alignments in frames; silences are left out."""
    df = spark.read.schema(ALIGNMENT).option("multiLine", True).json(path).select("*", F.input_file_name().alias("file"))
    w = df.select("file", "frame_rate", F.posexplode("words").alias("k", "w"))
    p = w.select("file", "frame_rate", F.col("k").alias("word_at"), F.col("w.word").alias("word"), F.explode("w.phones").alias("p"))
    seconds = lambda c: F.col(c) / F.col("frame_rate")
    return p.where(~F.upper("p.phone").isin("SIL", "SP", "")).select("file", "word_at", "word", F.col("p.phone").alias("phone"), seconds("p.start").alias("start"), seconds("p.duration").alias("duration"))


def save_matrix(spark: SparkSession, path: str) -> None:
    """The distance matrix with the fingerprint of the metric that made it."""
    rows = [(a, b, float(D.matrix()[i, j])) for i, a in enumerate(D.I.phones()) for j, b in enumerate(D.I.phones()) if j < i]
    spark.createDataFrame(rows, "a string, b string, d double").withColumn("metric", F.lit(D.metric_fingerprint())).coalesce(1).write.mode("overwrite").parquet(path)


def load_matrix_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, d) of a labelled phone by phone table, both directions averaged."""
    lines = [r[0].split("\t") for r in spark.read.text(path).collect()]  # a matrix of an inventory, small by nature
    head = lines[0][1:]
    cell = {(r[0], c): float(v) for r in lines[1:] for c, v in zip(head, r[1:], strict=True)}
    return spark.createDataFrame([(a, b, (v + cell.get((b, a), v)) / 2) for (a, b), v in cell.items()], "a string, b string, d double")


def load_matrix_json(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, d) from phones and the upper triangle, as a full symmetric table."""
    found = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    own, rows, k = found["phones"], [], 0
    for i, a in enumerate(own):
        rows.append((a, a, 0.0))
        for b in own[i + 1 :]:
            rows += [(a, b, float(found["upper"][k])), (b, a, float(found["upper"][k]))]
            k += 1
    return spark.createDataFrame(rows, "a string, b string, d double")


def read_phoneset(spark: SparkSession, path: str) -> DataFrame:
    """(phone, line): one phone a line, without silences and empty lines, imported as spellings from outside."""
    from ..functions import text as X
    from .corpus import numbered

    rows = numbered(spark, path).select(F.trim("value").alias("phone"), "line")
    return rows.where(~F.lower("phone").isin("", "sil", "sp", "spn", D.I.SILENCE)).select(X.from_wild(F.col("phone")).alias("phone"), "line")


def distance_model(spark: SparkSession, path: str, gamma: float = 1.0) -> D.DistanceModel:
    """A model on a matrix file: labelled tab-separated, or JSON with the upper triangle."""
    return D.DistanceModel.from_matrix(load_matrix_json(spark, path) if path.endswith(".json") else load_matrix_tsv(spark, path), gamma)
