"""Streaming ingest of transcriptions: lines arrive as files, good ones become forms, the others refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def read_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def accepted_and_refused(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """(form, units, findings, accepted): stateless, so any number of executors can share it and a retry changes nothing."""
    form = X.expand_ligatures(X.normalize_lookalikes(F.trim(value_col)))
    return lines.select(form.alias("form"), X.units(form).alias("units"), X.findings(form).alias("findings")).withColumn("accepted", F.size("findings") == 0)


def write_forms(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append to Parquet, partitioned by acceptance; each file is taken exactly once thanks to the checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("accepted").outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, ts: str, form: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Units by window of event time; state of a window is dropped once the watermark has passed it."""
    return events.withWatermark(ts, late).select(ts, F.explode(X.units(F.col(form))).alias("unit")).groupBy(F.window(ts, window).alias("window"), "unit").agg(F.count("*").alias("n"))
