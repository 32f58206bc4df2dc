"""Event studies: summaries of targets overall and by segment, clusters, macro context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .temporal import cut


def moments(x: Column, *, flat: float = 4.0) -> list[Column]:
    """Count, mean, population deviation, 95 % interval of the mean, rates and their reading."""
    n, mean, error = F.count(x), F.avg(x), F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.nullif(F.count(x), F.lit(0)))
    low, high = F.round(mean - 1.96 * error, 4), F.round(mean + 1.96 * error, 4)
    rate = lambda c: F.round(F.coalesce(F.avg(F.when(x.isNotNull(), F.when(c, 1.0).otherwise(0.0))), F.lit(0.0)), 6)
    reading = F.when(n == 0, "insufficient_data").when(low > 0, "positive_mean_move").when(high < 0, "negative_mean_move").when(F.abs(F.round(mean, 4)) <= flat, "no_clear_direction").otherwise("directionally_uncertain")
    return [
        n.alias("n"), F.round(mean, 4).alias("mean_ticks"), F.round(F.stddev_pop(x), 4).alias("std_ticks"), F.round(error, 4).alias("standard_error_ticks"), low.alias("ci_low_ticks"), high.alias("ci_high_ticks"),
        rate(x > flat).alias("positive_rate"), rate(x < -flat).alias("negative_rate"), rate((x >= -flat) & (x <= flat)).alias("flat_rate"), reading.alias("interpretation"),
    ]


def target_summary(events: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """moments(), median, p10 and p90 of each column, grouped by name and any further columns (null is a group); a group without a value has null quantiles."""
    long = events.unpivot(by or [], columns, "target", "ticks") if by else events.select(F.explode(F.array(*(F.struct(F.lit(c).alias("target"), F.col(c).alias("ticks")) for c in columns))).alias("x")).select("x.*")
    keys = [*(by or []), "target"]
    long = cut(long.select(F.struct(*keys).alias("_group"), "ticks"))
    found = quantiles(long, "_group", "ticks", {"median_ticks": 0.5, "p10_ticks": 0.1, "p90_ticks": 0.9})
    out = long.groupBy("_group").agg(*moments(F.col("ticks"))).join(found, "_group", "left")
    rounded = {c: F.round(c, 4) for c in ("median_ticks", "p10_ticks", "p90_ticks")}
    return out.withColumns(rounded).select("_group.*", *(c for c in out.columns if c != "_group"))


def topic_rows(events: DataFrame, topics: str = "rule_topic_labels") -> DataFrame:
    """One row per event and non-blank topic; topics are an array, or text joined by `|`."""
    column = F.col(topics) if dict(events.dtypes)[topics].startswith("array") else F.split(F.coalesce(topics, F.lit("")), r"\|")
    names = F.filter(F.transform(column, lambda t: F.trim(t)), lambda t: t != "")
    return events.withColumn("topic", F.explode(names))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("event_count"), F.count_if("market_whipsaw_flag").alias("market_whipsaw_count"))


def label_counts(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))


def segments(events: DataFrame, column: str, long: str, long_range: str, long_volatility: str) -> DataFrame:
    """Count and means of the longest horizon by label."""
    return events.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(long), 4).alias("mean_ticks"), F.round(F.avg(long_range), 4).alias("mean_range_ticks"), F.round(F.avg(long_volatility), 4).alias("mean_volatility_ticks"))


def cluster_summary(events: DataFrame) -> DataFrame:
    """Histogram of cluster sizes with totals: size, clusters, events, all clusters, isolated and burst events, largest size."""
    sizes = events.groupBy("event_cluster_number").agg(F.count("*").alias("size"))
    per = sizes.groupBy("size").agg(F.count("*").alias("clusters"), F.sum("size").alias("events"))
    whole = per.agg(F.sum("clusters").alias("cluster_count"), F.sum(F.when(F.col("size") == 1, F.col("events")).otherwise(0)).alias("isolated_events"), F.sum(F.when(F.col("size") > 1, F.col("events")).otherwise(0)).alias("burst_events"), F.max("size").alias("max_size"))
    return per.crossJoin(whole)


def macro_summary(events: DataFrame) -> DataFrame:
    """Events and blackout events by type of the nearest calendar event (`none` where there is none)."""
    return events.groupBy(F.coalesce("nearest_macro_event_type", F.lit("none")).alias("macro_type")).agg(F.count("*").alias("n"), F.count_if("is_macro_blackout").alias("blackout"))
