"""Exact quantiles of any number of groups, of which one may have all rows: no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import cut, first_after, ranged, running


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group and a column for each share: the quantile of the group's non-null values, between neighbours by their distance.

    Equal values are counted first. Distinct ones are sorted by ranges of equal numbers; running counts give each the
    last rank it has, and a rank's value is the first that reaches it. Groups without a value are left out; a null
    group has to be part of a struct, which is not null itself.
    """
    counted = cut(df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n")))
    ranks = running(ranged(counted, ["g", "x"]), ["x"], {"upto": F.col("n")}, by=["g"]).select("g", "x", (F.col("upto") - 1).alias("rank"))
    asks = counted.groupBy("g").agg(F.sum("n").alias("n")).select("g", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share")) for name, share in shares.items()))).alias("a"), "n")
    place = F.col("a.share") * (F.col("n") - 1)
    asks = asks.select("g", "a.name", place.alias("place"), F.explode(F.array(F.floor(place).cast("long"), F.ceil(place).cast("long"))).alias("rank"))
    found = first_after(asks, ranks, keys=["g", "name", "place", "rank"], at="rank", point_at="rank", by=["g"])
    ends = found.groupBy("g", "name", "place").agg(F.min("match.x").alias("low"), F.max("match.x").alias("high"))
    value_at = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))
    return ends.groupBy(F.col("g").alias(group)).agg(*(F.max(F.when(F.col("name") == name, value_at)).alias(name) for name in shares))
