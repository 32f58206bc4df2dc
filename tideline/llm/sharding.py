"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each source partition sends to each shard is drawn exactly as a uniform shuffle would have it.
Partitions then permute their rows locally and deal them out by those counts, rows are exchanged, and every
shard permutes again. Partitions are drawn by a seeded hash of id and text, so that a seed gives the same
shuffle for any file layout and after any loss of an executor.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialised, parallelism

ROWS_PER_PART = 250_000
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among `draws` of good + bad; beyond numpy's range by inversion outwards from the mode."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    lg = math.lgamma

    def log_p(k: int) -> float:
        return -(lg(k + 1) + lg(good - k + 1) + lg(draws - k + 1) + lg(bad - draws + k + 1))

    mode = min(max(low, (draws + 1) * (good + 1) // (good + bad + 2)), high)
    total = lg(good + bad + 1) - lg(good + 1) - lg(bad + 1) - lg(draws + 1) - lg(good + bad - draws + 1)
    u = rng.random()
    at, left, right = math.exp(log_p(mode) - total), mode, mode
    p_left = p_right = at
    u -= at
    while u > 0 and (left > low or right < high):
        if right < high:
            k = right
            p_right *= (good - k) / (k + 1) * (draws - k) / (bad - draws + k + 1)
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            k = left
            p_left *= k / (good - k + 1) * (bad - draws + k) / (draws - k + 1)
            left -= 1
            u -= p_left
            if u <= 0:
                return left
        if p_left + p_right < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition to each shard: row sums are counts, column sums are sizes."""
    rng, rest, matrix = np.random.default_rng(seed), list(sizes), []
    for n in counts:
        row, left, pool = [], n, sum(rest)
        for size in rest:
            k = hypergeometric(rng, size, pool - size, left)
            row.append(k)
            left, pool = left - k, pool - size
        rest = [r - k for r, k in zip(rest, row, strict=True)]
        matrix.append(row)
    return matrix


def _told_apart(slim: DataFrame) -> DataFrame:
    """slim without src, with a key of its own for each of the rows that share one: keys are counted by source partition, and repeats numbered from there.

    The numbers of m equal rows are 0 to m - 1 in any layout. No window has more rows than a source partition.
    """
    counts = slim.groupBy("key", "src").agg(F.count("*").alias("n"))
    own = Window.partitionBy("key")
    places = counts.withColumns({"all": F.sum("n").over(own), "before": F.sum("n").over(own.orderBy("src")) - F.col("n")}).where("all > 1").select("key", "src", "before")
    again = F.col("before") + F.row_number().over(Window.partitionBy("key", "src").orderBy("id", "crc", "size")) - 1
    rows = slim.join(places, ["key", "src"], "left").withColumn("again", F.when(F.col("before").isNotNull(), again).otherwise(0))
    return rows.select("id", "size", "crc", F.when(F.col("again") > 0, F.xxhash64("key", "again")).otherwise(F.col("key")).alias("key"))


def shuffle_to_shards(df: DataFrame, *, shards: int = 24, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Deal all rows into shards whose row counts differ by one at most, each in random order.

    Returns id_col, size (UTF-8 bytes of the text plus 8), text_crc32, shard and slot (gapless from 0 in each
    shard), a row for each input row. A null text has 0 bytes and checksum 0. Null and repeated ids and
    repeated rows are rows like any other; other columns are ignored; an empty table gives an empty result.
    The driver holds one number for each partition and shard; a partition has about rows_per_part rows.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("key"),
    )
    slim = materialised(_told_apart(materialised(slim.withColumn("src", F.spark_partition_id()), "shard-source")), "shard-rows")
    n = slim.count()
    parts = max(parallelism(spark), math.ceil(n / rows_per_part))
    subs = max(1, math.ceil(parts / shards))
    slim = slim.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(parts)).cast("int"))
    counts = {r["part"]: r["count"] for r in slim.groupBy("part").count().collect()}
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], [n // shards + (i < n % shards) for i in range(shards)], seed)
    cuts = spark.createDataFrame([(p, np.cumsum(row).tolist()) for p, row in zip(order, matrix, strict=True)], "part int, cuts array<long>")
    local = Window.partitionBy("part").orderBy("key", "id", "crc", "size")
    dealt = (
        slim.withColumn("at", F.row_number().over(local) - 1)
        .join(cuts, "part")
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("at"))))
        .select("id", "size", "crc", "key", "shard", F.pmod(F.xxhash64(F.lit(seed + 2), "key"), F.lit(subs)).cast("int").alias("sub"), F.xxhash64(F.lit(seed + 3), "key").alias("second"))
    )
    dealt = materialised(dealt, "shard-dealt")
    before = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).drop("n")
    again = Window.partitionBy("shard", "sub").orderBy("second", "key", "id", "crc", "size")
    return (
        dealt.withColumn("at", F.row_number().over(again) - 1)
        .join(before, ["shard", "sub"])
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("at")).alias("slot"))
    )
