"""Label review: the queue for reviewers, checks of what comes back, audits and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONTRADICTION, DEFAULT_RULES, MARKET_RELEVANCE, SENTIMENTS, TRADEABILITY
from .quality import utc_timestamp

# Columns of the review file.
BLANK = ["human_sentiment_label", "human_tradeability_label", "human_topic_labels", "market_relevance_label", "contradiction_label", "label_confidence", "reviewer_id", "reviewed_at_utc", "review_notes"]
REQUIRED = ["event_id", "post_id", "human_sentiment_label", "human_tradeability_label", "human_topic_labels", "market_relevance_label", "contradiction_label", "label_confidence", "reviewer_id", "reviewed_at_utc"]


def label_queue(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Events in order of receipt for review: what was known before the market moved, rule hints, blank human columns."""
    joined = lambda c: F.concat_ws("|", c)
    has = lambda c, default: F.col(c) if c in events.columns else F.lit(default)
    out = events.orderBy("received_at_utc", "event_id")
    out = out.limit(limit) if limit is not None else out
    domains = joined("url_domains") if "url_domains" in events.columns else F.lit("")
    return out.select("event_id", "post_id", "received_at_utc", "text_clean", has("has_image", False).alias("has_image"), has("has_video", False).alias("has_video"), domains.alias("url_domains"), "rule_sentiment_label", "rule_tradeability_label", joined("rule_topic_labels").alias("rule_topic_labels"), *(F.lit("").alias(c) for c in BLANK))


def check_reviews(reviews: DataFrame, label_version: str, topics: list[str] | None = None) -> DataFrame:
    """Reviewed rows (all text) with typed columns, label_version and `problems`, an array that is empty for good rows."""
    allowed = topics or [*DEFAULT_RULES.topics, DEFAULT_RULES.other]
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    names = F.filter(F.transform(F.split(text("human_topic_labels"), r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    sure = text("label_confidence").try_cast("double")
    domains = {"human_sentiment_label": SENTIMENTS, "human_tradeability_label": TRADEABILITY, "market_relevance_label": MARKET_RELEVANCE, "contradiction_label": CONTRADICTION}
    checks = [F.when(text(c) == "", F.lit(f"{c} is required")) for c in REQUIRED]
    checks += [F.when((text(c) != "") & ~text(c).isin(*values), F.concat(F.lit(f"invalid {c} "), text(c))) for c, values in domains.items()]
    checks += [
        F.when(F.size(F.array_except(names, F.array(*map(F.lit, allowed)))) > 0, F.lit("invalid human_topic_labels")),
        F.when(sure.isNull() | ~sure.between(0.0, 1.0), F.lit("label_confidence must be between 0 and 1")),
        F.when((text("reviewed_at_utc") != "") & utc_timestamp(text("reviewed_at_utc")).isNull(), F.lit("reviewed_at_utc has no time with an offset")),
    ]
    return reviews.select(
        F.lit(label_version).alias("label_version"), *(text(c).alias(c) for c in ("event_id", "post_id", *domains, "reviewer_id")), names.alias("human_topic_labels"), sure.alias("label_confidence"),
        utc_timestamp(text("reviewed_at_utc")).alias("reviewed_at_utc"), (text("review_notes") if "review_notes" in reviews.columns else F.lit("")).alias("review_notes"), F.array_compact(F.array(*checks)).alias("problems"),
    )


def audit_reviews(reviews: DataFrame) -> DataFrame:
    """One row: rows, events, repeated (event, reviewer) rows, events with two reviewers or more."""
    per = reviews.groupBy("event_id").agg(F.count("*").alias("rows"), F.count_distinct("reviewer_id").alias("reviewers"))
    return per.agg(F.sum("rows").alias("row_count"), F.count("*").alias("unique_event_count"), (F.sum("rows") - F.sum("reviewers")).alias("duplicate_event_reviewer_rows"), F.count_if(F.col("reviewers") >= 2).alias("multi_review_event_count"))


def review_counts(reviews: DataFrame, columns: list[str]) -> DataFrame:
    """How many reviews have each value of each column (reviewers, labels): column_name, value, n. Nulls aren't counted."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return reviews.select(pairs.alias("x")).select("x.*").where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def agreement(reviews: DataFrame, labels: list[str]) -> DataFrame:
    """Share of events with two reviewers or more on whose label all agree, one row per label column."""
    per = reviews.groupBy("event_id").agg(F.count_distinct("reviewer_id").alias("_reviewers"), *(F.count_distinct(c).alias(c) for c in labels)).where("_reviewers >= 2")
    long = per.unpivot(["event_id"], labels, "label_column", "values")
    return long.groupBy("label_column").agg(F.count("*").alias("events"), F.round(F.avg(F.when(F.col("values") == 1, 1.0).otherwise(0.0)), 6).alias("unanimous_rate"))
