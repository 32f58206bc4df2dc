"""Signals from scored events: direction, action, probabilities, data quality, explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings

SETTINGS = Settings()
HORIZONS = (5, 15, 30)
EXPLAINED = ["headline_risk_score", "market_relevance_score", "text_contradiction_score", "post_burst_score", "direction_flip_score"]


def stale_flag(health: DataFrame, enabled: list[str]) -> DataFrame:
    """One row `provider_stale`: any enabled source is stale, or has no row in health (source, is_stale, is_healthy)."""
    known = health.where(F.col("source").isin(*enabled)) if enabled else health.where("false")
    bad = F.count_if(F.coalesce("is_stale", F.lit(True)) | ~F.coalesce("is_healthy", F.lit(False)))
    return known.agg(((bad > 0) | (F.count_distinct("source") < len(set(enabled)))).alias("provider_stale"))


def top_features(columns: list[str] = EXPLAINED, n: int = 3) -> Column:
    """Names of the n largest positive columns, equal values in list order."""
    parts = F.array(*(F.struct((-F.col(c)).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(columns)))
    return F.transform(F.slice(F.array_sort(F.filter(parts, lambda x: x["v"] < 0)), 1, n), lambda x: x["c"])


def signals(scored: DataFrame, s: Settings = SETTINGS, *, market_stale: Column | bool = False, provider_stale: Column | bool = False) -> DataFrame:
    """One signal per scored event. Realised targets are never read: missing predictions count as one third and 0."""
    stale = F.lit(market_stale) if isinstance(market_stale, bool) else market_stale
    stale = stale | (F.lit(provider_stale) if isinstance(provider_stale, bool) else provider_stale)
    risk, sentiment, sure = F.col("whipsaw_risk_level"), F.col("rule_sentiment_label"), F.col("rule_sentiment_confidence")
    blocked = risk.isin("SOFT_RISK", "HARD_KILL")
    direction = (
        F.when(blocked | (sure < s.min_direction_confidence), "NO_TRADE").when(sentiment == "bullish_market", "BULLISH").when(sentiment == "bearish_market", "BEARISH").when(sentiment == "geopolitical_risk", "NO_TRADE").otherwise("NEUTRAL")
    )
    out = scored.withColumn("_direction", direction)
    none = F.array().cast("array<string>")
    reasons = lambda *x: F.array(*map(F.lit, x)) if x else none
    switch = lambda action, m, ttl, why: F.struct(F.lit(action).alias("action"), F.lit(m).alias("risk_multiplier"), F.lit(ttl).alias("ttl_seconds"), why.alias("reason_codes"))
    kill = (
        F.when(stale, switch("BLOCK_NEW_ENTRIES", 0.0, 0, reasons("NO_TRADE_DATA_STALE")))
        .when(risk == "HARD_KILL", switch(s.hard_action, 0.0, s.hard_ttl, reasons("WHIPSAW_RISK")))
        .when(risk == "SOFT_RISK", switch(s.soft_action, 0.5 if s.soft_action == "REDUCE_SIZE" else 0.0, s.soft_ttl, reasons("WHIPSAW_RISK")))
        .when(F.col("_direction") == "NO_TRADE", switch("BLOCK_NEW_ENTRIES", 0.0, 900, reasons("NO_TRADE_LOW_CONFIDENCE")))
        .otherwise(switch("ALLOW", 1.0, 900, F.when(risk == "WATCH", reasons("WATCH")).otherwise(none)))
    )
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in scored.columns else F.lit(default)
    odds, deltas = [], []
    for h in HORIZONS:
        up, down, flat = (has(f"p_{d}_{h}m", 1 / 3) for d in ("up", "down", "flat"))
        total = up + down + flat
        for name, p in (("up", up), ("down", down), ("flat", flat)):
            odds += [F.lit(f"{name}_{h}m"), F.when(total > 0, F.round(p / total, 6)).otherwise(F.round(F.lit(1 / 3), 6))]
        deltas += [F.lit(f"{h}m"), has(f"expected_delta_{h}m_ticks", 0.0).cast("double")]
    lag = F.unix_millis("received_at_utc") - F.unix_millis("created_at_utc")
    return out.select(
        "event_id", "post_id", "received_at_utc", F.when(stale, "low_confidence").otherwise(sentiment).alias("sentiment_label"), F.round(sure, 6).alias("sentiment_confidence"),
        F.when(stale, "ambiguous").when(blocked, "no_trade_whipsaw").otherwise(F.coalesce("rule_tradeability_label", F.lit("ambiguous"))).alias("tradeability_label"),
        F.when(stale, "NO_TRADE").otherwise(F.col("_direction")).alias("direction_signal"), F.create_map(*odds).alias("p_direction"), F.create_map(*deltas).alias("expected_delta_ticks"),
        F.struct(risk.alias("whipsaw_risk_level"), F.col("whipsaw_score"), F.col("headline_risk_score").alias("volatility_risk_score"), "p_next_post_15m", "p_next_post_30m", "p_next_post_60m").alias("risk"),
        kill.alias("kill_switch"), F.struct(lag.alias("feed_lag_ms"), F.lit(0).alias("market_data_lag_ms"), (~stale).alias("features_complete")).alias("data_quality"),
        F.struct(top_features().alias("top_features"), "contradicting_post_ids").alias("explanation"),
    )


def latest(df: DataFrame, ts: str = "received_at_utc", tie: str = "event_id") -> DataFrame:
    """The newest row, one for the whole table."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(ts, tie)).alias("_row")).where("_row is not null").select("_row.*")


def gauges(signals_: DataFrame) -> DataFrame:
    """(event_id, metric, value) of score, feed lag and multiplier."""
    flat = signals_.select("event_id", F.col("risk.whipsaw_score").alias("whipsaw_score"), F.col("data_quality.feed_lag_ms").cast("double").alias("feed_lag_ms"), F.col("kill_switch.risk_multiplier").alias("risk_multiplier"))
    return flat.unpivot(["event_id"], ["whipsaw_score", "feed_lag_ms", "risk_multiplier"], "metric", "value")
