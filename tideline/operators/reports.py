"""Digests of other reports: model comparison, readiness gates and build audits, as one-row frames and small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_ARCHIVE_ROWS = 1_000
MIN_HUMAN_LABELS = 500
FIXTURE_PREFIX = "fixture"


def side_by_side(frames: list[DataFrame]) -> DataFrame:
    """One-row frames as one row: joined by a constant key, all columns kept."""
    one = [f.withColumn("_one", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(b, "_one", "full"), one).drop("_one")


def readiness(archive: DataFrame, bars: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row from audit_posts(), audit_bars() and audit_reviews(): the gates, and the status that follows from all."""
    rows = side_by_side([archive.select(F.col("row_count").alias("archive_rows")), bars.select("sources"), reviews.select(F.col("row_count").alias("human_labels"))])
    names = F.filter(F.split(F.coalesce("sources", F.lit("")), ","), lambda x: x != "")
    licensed = (F.size(names) > 0) & ~F.exists(names, lambda x: F.startswith(x, F.lit(FIXTURE_PREFIX)))
    gates = {
        "real_post_archive_verified": F.coalesce(F.col("archive_rows") >= MIN_ARCHIVE_ROWS, F.lit(False)),
        "licensed_market_data_loaded": licensed,
        "human_label_minimum_met": F.coalesce(F.col("human_labels") >= MIN_HUMAN_LABELS, F.lit(False)),
    }
    out = rows.select(*(c.alias(k) for k, c in gates.items()))
    out = out.withColumn("transformer_training_ready", F.col("licensed_market_data_loaded") & F.col("human_label_minimum_met"))
    ready = reduce(lambda a, b: a & b, (F.col(c) for c in out.columns))
    return out.withColumns({"status": F.when(ready, "real_research_ready").otherwise("not_research_ready"), "review_status": F.when(ready, "shadow_review_ready").otherwise("fixture_shadow_only")})


def data_quality(archive: DataFrame, bars: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row of what the three audits say of their tables."""
    return side_by_side(
        [
            archive.select(F.col("row_count").alias("archive_post_rows"), F.col("empty_text_rows").alias("archive_empty_text_rows")),
            bars.select(F.col("row_count").alias("market_rows"), F.col("valid_rows").alias("market_valid_rows"), F.col("sources").alias("market_source_names")),
            reviews.select(F.col("row_count").alias("human_label_rows"), F.col("unique_event_count").alias("human_label_unique_events")),
        ]
    )


def whipsaw_digest(evaluation: DataFrame) -> DataFrame:
    return evaluation.select("row_count", "soft_precision", "soft_recall", "hard_precision", "hard_recall")


def backtest_digest(report: DataFrame) -> DataFrame:
    return report.select("trade_count", "net_pnl_before_usd", "net_pnl_after_usd", "kill_switch_value_usd", "avoided_losing_trade_usd", "missed_winning_trade_usd")


def best_model(models: DataFrame) -> DataFrame:
    """Of (position, model, status, macro_f1, ...) the trained row with the largest macro F1, the first of equals."""
    trained = models.where("status = 'trained' and macro_f1 is not null")
    return trained.agg(F.max_by(F.struct(*models.columns), F.struct("macro_f1", -F.col("position"))).alias("m")).where("m is not null").select("m.*")


def classifier_digest(models: DataFrame) -> DataFrame:
    """The best trained model of a comparison in one row; no row where none is trained."""
    return best_model(models).select("model", "n", "accuracy", "macro_f1")


def walk_forward_digest(summary: DataFrame) -> DataFrame:
    """Of metrics.walk_forward_summary() the row with the largest mean macro F1 over folds, the smallest name of equals."""
    best = summary.agg(F.min(F.struct((-F.col("macro_f1_mean")).alias("order"), "model", "folds", "n", "accuracy", "macro_f1", "macro_f1_mean", "macro_f1_std")).alias("m"))
    return best.where("m is not null").select(*(f"m.{c}" for c in ("model", "folds", "n", "accuracy", "macro_f1", "macro_f1_mean", "macro_f1_std")))


def event_build_audit(posts: DataFrame, bars: DataFrame, events: DataFrame, skipped: DataFrame) -> DataFrame:
    """(measure, n): posts, bars, valid bars, events, skipped posts, and skipped posts by reason as `skipped:<reason>`."""
    valid = F.count_if("is_valid_bar") if "is_valid_bar" in bars.columns else F.count("*")
    named = lambda df, c, name: df.agg(c.alias("n")).select(F.lit(name).alias("measure"), "n")
    rows = [named(posts, F.count("*"), "input_post_count"), named(bars, F.count("*"), "market_bar_count"), named(bars, valid, "market_valid_bar_count"), named(events, F.count("*"), "event_count"), named(skipped, F.count("*"), "skipped_post_count")]
    by = skipped.groupBy(F.concat(F.lit("skipped:"), "reason").alias("measure")).agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [*rows, by])
