"""Sinks: tables, reports and the raw log by day. Tables with a newest row for each key are in tables.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import utc_day

#: Spark's own format for text files stops at milliseconds
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, or CSV where the path says so; Spark's commit replaces the old files only on success."""
    writer = df.write.mode("overwrite")
    writer.options(header=True, timestampFormat=STAMP).csv(path) if path.lower().endswith(".csv") else writer.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", STAMP).json(path)


def append_raw(df: DataFrame, path: str, ts: str = "received_at_utc", *, batch: str | None = None) -> None:
    """Appends JSON lines below a folder for each day (UTC, whatever the session's zone) and, in it, for the batch.

    A batch that is written again replaces its own lines, so that a retry doesn't repeat them. Without a name every call is a batch of its own.
    """
    rows = df.withColumns({"day": utc_day(F.col(ts)), "batch": F.lit(batch or f"once-{uuid.uuid4().hex}")})
    rows.write.mode("overwrite").options(partitionOverwriteMode="dynamic", timestampFormat=STAMP).partitionBy("day", "batch").json(path)


def read_raw(spark: SparkSession, path: str, schema: str | T.StructType, *, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Rows of the raw log with day (UTC, a date; null for rows without a time) and batch. Days before the first or after the last one asked for aren't read, nor are rows without a time then."""
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(T.StructType([*known.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.StringType())])).json(path)
    for day, within in ((first_day, F.col("day").__ge__), (last_day, F.col("day").__le__)):
        rows = rows if day is None else rows.where(within(F.lit(day).cast("date")))
    return rows
