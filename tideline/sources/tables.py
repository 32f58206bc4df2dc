"""Tables by key with a newest row for each, replaced a bucket at a time: what a commit names is the table, all else isn't there yet.

    commits/n=<number>/   one JSON row: buckets (how many, where a key's hash tells its bucket), versions (of every bucket that has rows), writers (the last batch of each), layout (of the columns)
    data/v=<number>/_bucket=<bucket>/   the bucket's rows as the commit of that number left them

A writer that dies before its commit leaves files that no commit names; the same number is written over next time.
One writer at a time. Files of earlier commits stay until they are cleared, so that readers keep what they opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import keep_latest
from ..operators.temporal import cut

BUCKETS = 64
COMMIT = "buckets int, versions map<string, long>, writers map<string, long>, layout string, n long"


@dataclass(frozen=True)
class Commit:
    number: int
    versions: dict[int, int]
    writers: dict[str, int]
    layout: T.StructType | None
    buckets: int

    def has(self, writer: str | None, batch: int | None) -> bool:
        """Is that batch of that writer in the table already?"""
        return writer is not None and self.writers.get(writer, -1) >= (batch or 0)


def last_commit(spark: SparkSession, path: str, *, buckets: int = BUCKETS) -> Commit:
    """The newest commit; of a table that isn't there, number 0 with empty buckets."""
    try:
        row = spark.read.schema(COMMIT).json(f"{path}/commits").orderBy(F.col("n").desc()).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    if row is None:
        return Commit(0, {}, {}, None, buckets)
    return Commit(row["n"], {int(b): v for b, v in (row["versions"] or {}).items()}, dict(row["writers"] or {}), T.StructType.fromJson(json.loads(row["layout"])), row["buckets"])


def rows_of(spark: SparkSession, path: str, commit: Commit, buckets: Iterable[int]) -> DataFrame | None:
    """The rows of these buckets as the commit has them, read from their files alone; None where all of them are empty."""
    places = [f"{path}/data/v={commit.versions[b]}/_bucket={b}" for b in buckets if b in commit.versions]
    return spark.read.schema(commit.layout).parquet(*places) if places else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    commit = last_commit(spark, path)
    if commit.layout is None:
        raise ValueError(f"no table at {path}")
    found = rows_of(spark, path, commit, commit.versions)
    return found if found is not None else spark.createDataFrame([], commit.layout)


def replace(spark: SparkSession, path: str, last: Commit, rows: DataFrame, bucket: Column, touched: list[int], *, writer: str | None = None, batch: int | None = None) -> None:
    """Commits rows as all that the touched buckets now hold; `bucket` tells a row's, and each of them has rows."""
    number = last.number + 1
    if touched:
        parts = min(len(touched), int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows.withColumn("_bucket", bucket).repartition(parts, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v={number}")
    versions = {str(b): v for b, v in (last.versions | dict.fromkeys(touched, number)).items()}
    writers = last.writers | ({writer: batch or 0} if writer is not None else {})
    row = spark.createDataFrame([(last.buckets, versions, writers, rows.schema.json())], "buckets int, versions map<string, long>, writers map<string, long>, layout string")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/commits/n={number}")


def upsert(new: DataFrame, path: str, *, keys: tuple[str, ...] = ("post_id", "content_hash"), newest_by: str = "received_at_utc", writer: str | None = None, batch: int | None = None, buckets: int = BUCKETS) -> bool:
    """Merges rows into the table at path: per key (null is a value like any other) the row with the largest newest_by stays.

    Buckets follow from the key alone, so that no other column, null, or session zone can part the rows of a key. Only
    buckets that new rows touch are read and written again. A batch of a writer that is already committed is left out:
    False is returned. `buckets` counts for a new table only.
    """
    spark = new.sparkSession
    commit = last_commit(spark, path, buckets=buckets)
    if commit.has(writer, batch):
        return False
    bucket = F.pmod(F.xxhash64(*keys), F.lit(commit.buckets)).cast("int")
    rows = cut(new.withColumn("_bucket", bucket))
    touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
    old = rows_of(spark, path, commit, touched)
    merged = rows.drop("_bucket")
    if old is not None:
        merged = old.unionByName(merged, allowMissingColumns=True)
    replace(spark, path, commit, keep_latest(merged, list(keys), [F.col(newest_by)]), bucket, touched, writer=writer, batch=batch)
    return True
