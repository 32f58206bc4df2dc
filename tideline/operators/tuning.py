"""Search of risk weights and thresholds: every trial is scored in one aggregate over the distinct labelled rows."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .risk import COMPONENTS, WEIGHTS, binary_metrics

#: Trials are copied to every row, so that their number is bounded.
MAX_TRIALS = 1_000


@dataclass(frozen=True)
class Trial:
    number: int
    weights: dict[str, float]
    soft: float
    hard: float


#: The weights and thresholds that risk.score() has.
DEFAULT_TRIAL = Trial(0, WEIGHTS, 0.55, 0.75)


def random_trials(n: int = 60, seed: int = 42) -> list[Trial]:
    """Seeded candidates: weights that add up to 1, a soft threshold from 0.2 to 0.8 and a hard one at least 0.05 above."""
    if not 0 < n <= MAX_TRIALS:
        raise ValueError(f"trials must be 1 to {MAX_TRIALS}")
    rng, out = random.Random(seed), []
    for i in range(1, n + 1):
        raw = [rng.random() for _ in COMPONENTS]
        soft = rng.uniform(0.2, 0.8)
        hard = rng.uniform(min(0.95, soft + 0.05), 0.95)
        out.append(Trial(i, {c: round(x / sum(raw), 6) for c, x in zip(COMPONENTS, raw, strict=True)}, round(soft, 6), round(hard, 6)))
    return out


def evaluate_trials(scored: DataFrame, trials: list[Trial]) -> DataFrame:
    """Per trial the confusion of soft and hard predictions against market_whipsaw_flag, the share predicted, and the objective.

    scored has the component columns. Rows with equal components and flag are counted first, so that a trial is
    scored once for each of them, not for each row; partial counts of each trial are made before anything moves.
    """
    if len(trials) > MAX_TRIALS:
        raise ValueError(f"more than {MAX_TRIALS} trials")
    value = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in COMPONENTS))
    candidates = F.array(*(F.struct(F.lit(t.number).alias("trial"), F.array(*(F.lit(float(t.weights[c])) for c in COMPONENTS)).alias("w"), F.lit(t.soft).alias("soft"), F.lit(t.hard).alias("hard")) for t in trials))
    equal = scored.select(value.alias("v"), F.coalesce("market_whipsaw_flag", F.lit(False)).alias("actual")).groupBy("v", "actual").agg(F.count("*").alias("n"))
    rows = equal.select("v", "actual", "n", F.explode(candidates).alias("t"))
    total = F.aggregate(F.zip_with("t.w", "v", lambda w, x: w * x), F.lit(0.0), lambda a, x: a + x)
    rows = rows.select("t.trial", "actual", "n", "t.soft", "t.hard", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 9).alias("score"))
    soft, hard = F.col("score") >= F.col("soft"), F.col("score") >= F.col("hard")
    n = F.col("n")
    rate = F.round(F.sum(F.when(soft, n).otherwise(0)) / F.sum(n), 6)
    out = rows.groupBy("trial").agg(F.sum(n).alias("row_count"), *binary_metrics(F.col("actual"), soft, "soft", n), *binary_metrics(F.col("actual"), hard, "hard", n), rate.alias("risk_prediction_rate"))
    objective = 0.40 * F.col("soft_recall") + 0.25 * F.col("soft_precision") + 0.20 * F.col("hard_precision") + 0.10 * F.col("hard_recall") - 0.05 * F.greatest(F.lit(0.0), F.col("risk_prediction_rate") - 0.60)
    return out.withColumn("objective", F.round(objective, 6))


def best_trial(evaluated: DataFrame) -> DataFrame:
    """The row with the largest objective, the smallest trial of equals."""
    best = F.max_by(F.struct(*evaluated.columns), F.struct("objective", -F.col("trial")))
    return evaluated.agg(best.alias("b")).where("b is not null").select("b.*")


def tune(split: DataFrame, *, n_trials: int = 60, seed: int = 42) -> tuple[DataFrame, Trial]:
    """Report rows and the trial that is best on the rows whose `split` is train: it there, and it and the default on those of test."""
    trials = random_trials(n_trials, seed)
    trained = best_trial(evaluate_trials(split.where("split = 'train'"), trials)).withColumns({"split": F.lit("train"), "parameters": F.lit("best")})
    number = trained.select("trial").first()
    if number is None:
        raise ValueError("no training rows")
    best = next(t for t in trials if t.number == number[0])
    held = split.where("split = 'test'")
    rest = evaluate_trials(held, [best, DEFAULT_TRIAL]).withColumns({"split": F.lit("test"), "parameters": F.when(F.col("trial") == 0, "default").otherwise("best")})
    return trained.unionByName(rest), best
