"""Classification metrics, calibration, abstention, and chronological splits, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import cut, forward_asof, keyed, ranged, running, timed


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), "actual", "predicted").agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, by: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every class that is actual or predicted, or of all labels given; 0 on division by zero."""
    keys = by or []
    sides = F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"))))
    rows = confusion(df, by).select(*keys, F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"), sides.alias("x"))
    # each cell appears once per side; hits are counted on the actual side only
    per = rows.groupBy(*keys, "x.label").agg(F.sum("x.support").alias("support"), F.sum("x.claimed").alias("claimed"), F.sum(F.when(F.col("x.support") > 0, F.col("hit")).otherwise(0)).alias("hits"))
    if labels:
        groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).drop("id")
        per = groups.withColumn("label", F.explode(F.array(*map(F.lit, labels)))).join(per, [*keys, "label"], "left").fillna(0, ["support", "claimed", "hits"])
    precision, recall = F.when(F.col("claimed") > 0, F.col("hits") / F.col("claimed")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return per.select(*keys, "label", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), "hits")


def summary_metrics(df: DataFrame, by: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """Rows, accuracy and macro F1 (over all labels given, else over those that a group has)."""
    per = class_metrics(df, by, labels)
    out = per.groupBy(*by) if by else per.groupBy()
    return out.agg(F.sum("support").alias("n"), F.round(F.sum("hits") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def probability_metrics(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Brier score and log loss; classes maps labels to probability columns. Nulls count as 0, rows are renormalised, all-zero rows are uniform."""
    raw = {k: F.coalesce(F.col(c), F.lit(0.0)) for k, c in classes.items()}
    total = sum(raw.values(), F.lit(0.0))
    p = {k: F.when(total > 0, c / total).otherwise(1.0 / len(raw)) for k, c in raw.items()}
    brier = sum(((c - F.when(F.col("actual") == k, 1.0).otherwise(0.0)) ** 2 for k, c in p.items()), F.lit(0.0))
    own = F.coalesce(*(F.when(F.col("actual") == k, c) for k, c in p.items()), F.lit(0.0))
    return df.agg(F.round(F.avg(brier), 6).alias("brier"), F.round(F.avg(-F.log(F.greatest(own, F.lit(1e-15)))), 6).alias("log_loss"))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of confidence, the last one closed."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    right = F.when(F.col("actual") == F.col("predicted"), 1.0).otherwise(0.0)
    per = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(right).alias("a"))
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), 6).alias("ece"))


def _kept(df: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("confidence"))
    return df.select("actual", "predicted", F.explode(reached).alias("threshold"))


def abstention_curve(df: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Rows kept and left out, coverage, accuracy and macro F1 at each confidence threshold; no rows kept give null scores."""
    found = summary_metrics(_kept(df, thresholds), ["threshold"])
    # one row for each threshold with the number of all rows, in one pass
    every = df.agg(F.count("*").alias("_all")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    n = F.coalesce("n", F.lit(0).cast("long"))
    out = every.join(found, "threshold", "left")
    return out.select("threshold", n.alias("n"), (F.col("_all") - n).alias("abstained"), F.round(n / F.col("_all"), 6).alias("coverage"), "accuracy", "macro_f1")


def abstention_labels(df: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """How many of the rows kept at each threshold have each label: threshold, side (actual or predicted), label, n."""
    sides = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("label")) for c in ("actual", "predicted"))))
    return _kept(df, thresholds).select("threshold", sides.alias("x")).select("threshold", "x.*").groupBy("threshold", "side", "label").agg(F.count("*").alias("n"))


def majority(df: DataFrame, label: str = "actual") -> DataFrame:
    """The most frequent label, the smaller one of equals."""
    return df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), F.col(label).alias("label"))).alias("m")).select("m.label")


def row_index(df: DataFrame, order: list[str], ts: str) -> DataFrame:
    """0-based position in time order, without a global window; null for rows without a time."""
    df = keyed(df, "_place")
    slim = timed(df.select(*dict.fromkeys([*order, ts, "_place"])), ts)[0]
    placed = running(ranged(slim, [*order, "_place"]), [*order, "_place"], {"_n": F.lit(1)}).select("_place", (F.col("_n") - 1).alias("row_index"))
    return df.join(placed, "_place", "left").drop("_place")


def chronological_split(df: DataFrame, order: list[str], ts: str, test_share: float = 0.35) -> DataFrame:
    """Adds split: of the n rows with a time, the first max(1, floor(n (1 - share))) train, the rest test; null without a time."""
    df = keyed(df, "_place")
    n = df.where(F.col(ts).isNotNull()).count()
    first = max(1, int(n * (1 - test_share)))
    at = F.col("row_index")
    return row_index(df, order, ts).withColumn("split", F.when(at < first, "train").when(at >= first, "test"))


def walk_forward_folds(df: DataFrame, order: list[str], ts: str, *, first_train: int, test_rows: int, step: int, embargo_rows: int = 1, purge_minutes: int = 30) -> tuple[DataFrame, DataFrame]:
    """Folds (fold, test_start, test_end, test_begins, train_rows) and the rows with their row_index.

    Tests of test_rows rows begin every `step` rows. A fold trains on the rows with a row_index below train_rows:
    those before the embargo whose time is purge_minutes or more before the test begins. That is a prefix of the
    rows, so that no row is copied for the folds it trains. A fold with fewer than first_train rows is
    skipped without a number. Rows without a time are in no fold.
    """
    rows = cut(row_index(df, order, ts))
    placed = rows.where("row_index is not null")
    n, first = placed.count(), first_train + embargo_rows
    begins = placed.where((F.col("row_index") >= first) & ((F.col("row_index") - first) % step == 0))
    begins = begins.select(F.col("row_index").alias("test_start"), F.least(F.col("row_index") + test_rows, F.lit(n)).alias("test_end"), F.col(ts).alias("test_begins"))
    ends = placed.groupBy(ts).agg((F.max("row_index") + 1).alias("upto")).select((-F.unix_micros(ts)).alias("_at"), "upto")
    begins = begins.withColumn("_cutoff", F.lit(purge_minutes * 60_000_000) - F.unix_micros("test_begins"))
    found = forward_asof(begins, ends, "_cutoff", "_at", name="_last")
    found = found.withColumn("train_rows", F.least(F.col("test_start") - embargo_rows, F.coalesce("_last.upto", F.lit(0)))).where(F.col("train_rows") >= first_train)
    folds = running(ranged(found.drop("_last"), ["test_start"]), ["test_start"], {"fold": F.lit(1)})
    return folds.select("fold", "test_start", "test_end", "test_begins", "train_rows"), rows


def fold_tests(rows: DataFrame, folds: DataFrame, *, first_train: int, test_rows: int, step: int, embargo_rows: int = 1) -> DataFrame:
    """Rows with the fold they test (a row for each, where tests overlap): which tests a row can be in follows from its index."""
    back = F.col("row_index") - (first_train + embargo_rows)
    lowest, highest = F.greatest(F.ceil((back - test_rows + 1) / step), F.lit(0)), F.floor(back / step)
    number = F.explode(F.when(highest >= lowest, F.sequence(lowest, highest)).otherwise(F.array().cast("array<bigint>")))
    at = rows.where(F.col("row_index") >= first_train + embargo_rows).withColumn("_k", number)
    return at.withColumn("test_start", F.col("_k") * step + (first_train + embargo_rows)).drop("_k").join(folds.select("fold", "test_start"), "test_start").drop("test_start")


def walk_forward_summary(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """Per model of (model, fold, actual, predicted): rows, accuracy and macro F1 of all folds together, and mean, population deviation, least and largest macro F1 of the folds."""
    per = summary_metrics(predictions, ["model", "fold"], labels).groupBy("model").agg(
        F.count("*").alias("folds"), F.round(F.avg("macro_f1"), 6).alias("macro_f1_mean"), F.round(F.stddev_pop("macro_f1"), 6).alias("macro_f1_std"), F.min("macro_f1").alias("macro_f1_min"), F.max("macro_f1").alias("macro_f1_max")
    )
    return summary_metrics(predictions, ["model"], labels).join(per, "model")
