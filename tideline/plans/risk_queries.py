"""Queries over scored posts: bursts, timing, pair scores, risk, trades, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlay, risk, signals
from ..operators.temporal import cut
from . import views as v
from .views import ALIGNED_SQL, BASE_SQL, CORPUS_RULES, HOURLY, rules_sql

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def labelled(spark, d):
    return v.labelled(v.posts(spark, d, numbered=True), spark, d)


def scored(spark, d, *, context=False):
    """Scored posts; signals also need the context of their timing."""
    return risk.score(labelled(spark, d), HOURLY, CORPUS_RULES, context=context).withColumn("event_id", F.col("post_id"))


@query(f"WITH {BASE_SQL} {rules_sql()} SELECT post_id, array_to_string(topics, '|') AS topics, sentiment, confidence, tradeability FROM labelled")
def f7_rule_labels(spark, d):
    return labelled(spark, d).select("post_id", F.concat_ws("|", "rule_topic_labels").alias("topics"), F.col("rule_sentiment_label").alias("sentiment"), F.col("rule_sentiment_confidence").alias("confidence"), F.col("rule_tradeability_label").alias("tradeability"))


@query(f"WITH {BASE_SQL} {rules_sql()} SELECT sentiment AS label, tradeability, count(*) AS n FROM labelled GROUP BY 1, 2")
def a22_weak_label_audit(spark, d):
    return labelled(spark, d).groupBy(F.col("rule_sentiment_label").alias("label"), F.col("rule_tradeability_label").alias("tradeability")).agg(F.count("*").alias("n"))


COUNTS = ", ".join(f"count(*) OVER (ORDER BY epoch_us(received_at_utc) RANGE BETWEEN {m * 60_000_000} PRECEDING AND 1 PRECEDING) AS posts_last_{m}m" for m in risk.WINDOWS)


@query(f"WITH {BASE_SQL} SELECT post_id, {COUNTS} FROM posts")
def w5_burst_counts(spark, d):
    rows = v.posts(spark, d).withColumn("rule_topic_labels", F.array().cast("array<string>"))
    return risk.burst_counts(rows).select("post_id", *(f"posts_last_{m}m" for m in risk.WINDOWS))


ENTROPY_SQL = """,
prior AS (SELECT a.post_id, t.topic, count(*) AS n FROM labelled a JOIN labelled b ON b.received_at_utc < a.received_at_utc AND b.received_at_utc >= a.received_at_utc - INTERVAL 60 MINUTE, unnest(b.topics) t(topic) GROUP BY 1, 2),
shares AS (SELECT post_id, n / sum(n) OVER (PARTITION BY post_id) AS p FROM prior),
entropies AS (SELECT post_id, round(-sum(p * log2(p)), 6) AS e FROM shares GROUP BY 1)"""


@query(f"WITH {BASE_SQL} {rules_sql()} {ENTROPY_SQL} SELECT post_id, coalesce(e, 0) + 0 AS topic_entropy_60m FROM labelled LEFT JOIN entropies USING (post_id)")
def w6_topic_entropy(spark, d):
    return risk.burst_features(labelled(spark, d)).select("post_id", (F.col("topic_entropy_60m") + 0).alias("topic_entropy_60m"))


TIMING_SQL = """,
since AS (SELECT post_id, received_at_utc, (epoch_us(received_at_utc) - lag(epoch_us(received_at_utc)) OVER (ORDER BY received_at_utc, post_id)) / 60000000.0 AS gap FROM posts),
timing AS (SELECT post_id, coalesce(gap, 1440) AS minutes_since_previous_post, coalesce(round(avg(gap) OVER w, 4), 1440) AS expected_minutes_to_next_post,
  coalesce(round(count(*) FILTER (gap <= 15) OVER w / nullif(count(gap) OVER w, 0), 6), 0) AS p_next_post_15m, coalesce(round(count(*) FILTER (gap <= 30) OVER w / nullif(count(gap) OVER w, 0), 6), 0) AS p_next_post_30m, coalesce(round(count(*) FILTER (gap <= 60) OVER w / nullif(count(gap) OVER w, 0), 6), 0) AS p_next_post_60m
  FROM since WINDOW w AS (ORDER BY received_at_utc, post_id ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {BASE_SQL} {TIMING_SQL} SELECT * REPLACE (round(minutes_since_previous_post, 6) AS minutes_since_previous_post) FROM timing")
def w7_timing(spark, d):
    return risk.timing_features(v.posts(spark, d)).select("post_id", F.round("minutes_since_previous_post", 6).alias("minutes_since_previous_post"), "expected_minutes_to_next_post", "p_next_post_15m", "p_next_post_30m", "p_next_post_60m")


DIRECTION = "CASE WHEN {} = 'bullish_market' THEN 1 WHEN {} IN ('bearish_market', 'geopolitical_risk') THEN -1 ELSE 0 END"
A_DIR, B_DIR = DIRECTION.format("a.sentiment", "a.sentiment"), DIRECTION.format("b.sentiment", "b.sentiment")
PAIR_SQL = f""",
pairs AS (SELECT a.post_id, b.post_id AS prior, b.received_at_utc AS prior_at, len(list_intersect(a.topics, b.topics)) / len(list_distinct(a.topics || b.topics)) AS topic, ({A_DIR}) * ({B_DIR}) = -1 AS opposed
  FROM labelled a JOIN labelled b ON b.received_at_utc < a.received_at_utc AND b.received_at_utc >= a.received_at_utc - INTERVAL 60 MINUTE),
valued AS (SELECT *, CASE WHEN opposed THEN round(0.4 + 0.6 * topic, 4) ELSE 0 END AS txt FROM pairs),
paired AS (SELECT post_id, max(txt) AS text_contradiction_score, round(max(topic), 6) AS same_topic_score, max(opposed::INT)::DOUBLE AS direction_flip_score, first(prior ORDER BY txt DESC, prior_at, prior) FILTER (txt > 0) AS prior FROM valued GROUP BY 1)"""


@query(f"WITH {BASE_SQL} {rules_sql()} {PAIR_SQL} SELECT * FROM paired")
def j6_pair_scores(spark, d):
    return risk.pair_scores(cut(labelled(spark, d)), HOURLY).withColumnRenamed("_prior", "prior")


RISK_SQL = f"""{PAIR_SQL},
burst AS (SELECT post_id, {COUNTS} FROM posts),
parts AS (SELECT l.*, coalesce(p.text_contradiction_score, 0) AS c_text, coalesce(p.same_topic_score, 0) AS c_topic, coalesce(p.direction_flip_score, 0) AS c_flip, p.prior, round(least(1.0, b.posts_last_60m / 3.0), 6) AS c_burst,
  CASE WHEN sentiment IN ('bearish_market', 'geopolitical_risk') THEN 1.0 WHEN sentiment = 'volatility_only' THEN 0.65 WHEN sentiment = 'bullish_market' THEN 0.2 ELSE 0.0 END AS c_head,
  CASE WHEN len(list_intersect(l.topics, {CORPUS_RULES.relevant_topics})) > 0 THEN round(least(1.0, 0.4 + 0.2 * len(list_intersect(l.topics, {CORPUS_RULES.relevant_topics}))), 6) ELSE 0 END AS c_rel
  FROM labelled l JOIN burst b USING (post_id) LEFT JOIN paired p USING (post_id)),
risky AS (SELECT *, round(least(1.0, greatest(0.0, 0.35 * c_head::DOUBLE + 0.3 * c_rel::DOUBLE + 0.15 * c_text::DOUBLE + 0.03 * c_topic::DOUBLE + 0.1 * c_burst::DOUBLE + 0.07 * c_flip::DOUBLE)), 6) AS score FROM parts),
levels AS (SELECT *, CASE WHEN score >= 0.75 THEN 'HARD_KILL' WHEN score >= 0.55 THEN 'SOFT_RISK' WHEN score >= 0.25 THEN 'WATCH' ELSE 'NONE' END AS lvl FROM risky),
timed AS (SELECT *, CASE lvl WHEN 'HARD_KILL' THEN 3600 WHEN 'SOFT_RISK' THEN 1800 WHEN 'WATCH' THEN 900 ELSE 0 END AS ttl FROM levels)"""


@query(f"WITH {BASE_SQL} {rules_sql()} {RISK_SQL} SELECT post_id, score AS whipsaw_score, lvl AS whipsaw_risk_level, ttl AS risk_ttl_seconds, prior FROM timed")
def f14_risk_scores(spark, d):
    return scored(spark, d).select("post_id", "whipsaw_score", "whipsaw_risk_level", "risk_ttl_seconds", F.get("contradicting_post_ids", F.lit(0)).alias("prior"))


VALUES = "[c_head::DOUBLE, c_rel::DOUBLE, c_text::DOUBLE, c_topic::DOUBLE, c_burst::DOUBLE, c_flip::DOUBLE, 0]"
NAMES = [c for c in risk.COMPONENTS]


@query(f"WITH {BASE_SQL} {rules_sql()} {RISK_SQL} SELECT post_id, {NAMES}[list_position({VALUES}, list_max({VALUES}))] AS component, round(list_max({VALUES}), 6) AS value FROM timed")
def t5_dominant_component(spark, d):
    name, value = risk.dominant(risk.COMPONENTS)
    return scored(spark, d).select("post_id", name.alias("component"), F.round(value, 6).alias("value"))


@query(f"WITH {BASE_SQL} {rules_sql()} {RISK_SQL}, x AS (SELECT post_id, list_sort([y for y in [{{'v': -c_head::DOUBLE, 'i': 0, 'c': 'headline_risk_score'}}, {{'v': -c_rel::DOUBLE, 'i': 1, 'c': 'market_relevance_score'}}, {{'v': -c_text::DOUBLE, 'i': 2, 'c': 'text_contradiction_score'}}, {{'v': -c_burst::DOUBLE, 'i': 3, 'c': 'post_burst_score'}}, {{'v': -c_flip::DOUBLE, 'i': 4, 'c': 'direction_flip_score'}}] if y.v < 0])[1:3] AS top FROM timed) SELECT post_id, array_to_string([y.c for y in top], '|') AS top_features FROM x")
def t4_top_features(spark, d):
    return scored(spark, d).select("post_id", F.concat_ws("|", signals.top_features()).alias("top_features"))


METRICS = "count(*) FILTER ({0} AND {1}) AS {2}_tp, count(*) FILTER (NOT {0} AND {1}) AS {2}_fp, count(*) FILTER (NOT {0} AND NOT {1}) AS {2}_tn, count(*) FILTER ({0} AND NOT {1}) AS {2}_fn, coalesce(round(count(*) FILTER ({0} AND {1}) / nullif(count(*) FILTER ({1}), 0), 6), 0) AS {2}_precision, coalesce(round(count(*) FILTER ({0} AND {1}) / nullif(count(*) FILTER ({0}), 0), 6), 0) AS {2}_recall"
EVAL = "count(*) AS row_count, count(*) FILTER (lvl = 'HARD_KILL') AS n_hard_kill, count(*) FILTER (lvl = 'SOFT_RISK') AS n_soft_risk, count(*) FILTER (lvl = 'WATCH') AS n_watch, count(*) FILTER (lvl = 'NONE') AS n_none, " + METRICS.format("w", "lvl IN ('SOFT_RISK', 'HARD_KILL')", "soft") + ", " + METRICS.format("w", "lvl = 'HARD_KILL'", "hard") + ", round(avg(score) FILTER (w), 6) AS mean_score_true, round(avg(score) FILTER (NOT w), 6) AS mean_score_false"


@query(f"WITH {ALIGNED_SQL} {rules_sql()} {RISK_SQL} SELECT {EVAL} FROM (SELECT t.*, f.market_whipsaw_flag AS w FROM timed t JOIN flagged f USING (post_id))")
def a25_whipsaw_evaluation(spark, d):
    from ..operators import events as ev

    return risk.evaluate(scored(spark, d).join(ev.post_moves(v.posts(spark, d), v.bars(spark, d), HOURLY).select("post_id", "market_whipsaw_flag"), "post_id"))


TRADE_SQL = """,
raw_trades AS (SELECT event_id::VARCHAR AS trade_id, ts AS entry_ts_utc, ts + INTERVAL 3 HOUR AS exit_ts_utc, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, (1 + event_id % 3)::INTEGER AS contracts FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL),
entered AS (SELECT t.*, b.open AS entry_price FROM raw_trades t ASOF JOIN bars b ON t.entry_ts_utc <= b.ts_open_utc),
trades AS (SELECT t.*, b.close AS exit_price FROM entered t ASOF JOIN bars b ON t.exit_ts_utc <= b.ts_open_utc),
profits AS (SELECT *, round((CASE side WHEN 'long' THEN exit_price - entry_price ELSE entry_price - exit_price END) / 0.25 * 0.5 * contracts, 4) + 0 AS gross, round((CASE side WHEN 'long' THEN exit_price - entry_price ELSE entry_price - exit_price END) / 0.25 * 0.5 * contracts - (2 * 0.74 + 2 * 1.0 * 0.5) * contracts, 4) + 0 AS net FROM trades)"""


@query(f"WITH {BASE_SQL} {TRADE_SQL} SELECT trade_id, gross, net FROM profits")
def f20_trade_pnl(spark, d):
    t = v.trades(spark, d)
    return t.select("trade_id", overlay.pnl(F.col("contracts"), HOURLY, costs=False).alias("gross"), overlay.pnl(F.col("contracts"), HOURLY, costs=True).alias("net"))


REPLAY_SQL = f"""{RISK_SQL} {TRADE_SQL},
active AS (SELECT t.trade_id, first(r.post_id ORDER BY (CASE lvl WHEN 'HARD_KILL' THEN 0 ELSE 1 END), score DESC, r.post_id) AS blocking_event_id, first(r.lvl ORDER BY (CASE lvl WHEN 'HARD_KILL' THEN 0 ELSE 1 END), score DESC, r.post_id) AS lvl
  FROM trades t JOIN timed r ON lvl IN ('HARD_KILL', 'SOFT_RISK') AND t.entry_ts_utc BETWEEN r.received_at_utc + INTERVAL 2 SECOND AND r.received_at_utc + INTERVAL 2 SECOND + ttl * INTERVAL 1 SECOND GROUP BY 1),
decided_trades AS (SELECT p.*, a.blocking_event_id, a.lvl, CASE WHEN lvl = 'HARD_KILL' THEN 0 WHEN lvl = 'SOFT_RISK' THEN contracts // 2 ELSE contracts END AS after FROM profits p LEFT JOIN active a USING (trade_id)),
replayed AS (SELECT *, CASE WHEN lvl = 'HARD_KILL' OR (lvl = 'SOFT_RISK' AND after = 0) THEN 'filtered' WHEN lvl = 'SOFT_RISK' THEN 'reduced' ELSE 'unchanged' END AS status, CASE WHEN after <= 0 THEN 0 ELSE round((CASE side WHEN 'long' THEN exit_price - entry_price ELSE entry_price - exit_price END) / 0.25 * 0.5 * after - (2 * 0.74 + 2 * 1.0 * 0.5) * after, 4) + 0 END AS net_after FROM decided_trades),
final AS (SELECT *, round(net_after - net, 4) + 0 AS val FROM replayed)"""


@query(f"WITH {BASE_SQL} {rules_sql()} {REPLAY_SQL} SELECT trade_id, blocking_event_id, lvl AS blocking_risk_level FROM final")
def j7_trade_blockers(spark, d):
    return overlay.blockers(v.trades(spark, d), scored(spark, d), HOURLY).select("trade_id", "blocking_event_id", "blocking_risk_level")


LABEL = "CASE WHEN status IN ('filtered', 'reduced') AND val > 0 THEN 'helpful_risk_reduction' WHEN status IN ('filtered', 'reduced') AND val < 0 THEN 'false_positive_cost' WHEN status = 'unchanged' AND net < 0 THEN 'false_negative_loss' ELSE 'neutral_or_unaffected' END"


@query(f"WITH {BASE_SQL} {rules_sql()} {REPLAY_SQL} SELECT trade_id, status AS kill_switch_status, after::INTEGER AS contracts_after, net AS net_pnl_before_usd, net_after AS net_pnl_after_usd, val AS kill_switch_value_usd, {LABEL} AS attribution_label FROM final")
def f21_replayed_trades(spark, d):
    out = overlay.replay(v.trades(spark, d), scored(spark, d), HOURLY)
    return out.select("trade_id", "kill_switch_status", "contracts_after", "net_pnl_before_usd", "net_pnl_after_usd", "kill_switch_value_usd", "attribution_label")


@query(f"""WITH {BASE_SQL} {rules_sql()} {REPLAY_SQL} SELECT count(*) AS trade_count, count(*) FILTER (status = 'filtered') AS filtered_trades, count(*) FILTER (status = 'reduced') AS reduced_trades, count(*) FILTER (status = 'unchanged') AS unchanged_trades,
round(sum(net), 4) AS net_pnl_before_usd, round(sum(net_after), 4) AS net_pnl_after_usd, round(sum(net_after) - sum(net), 4) AS kill_switch_value_usd, round(coalesce(sum(-net) FILTER (status = 'filtered' AND net < 0), 0), 4) AS avoided_losing_trade_usd, round(coalesce(sum(net) FILTER (status = 'filtered' AND net > 0), 0), 4) AS missed_winning_trade_usd,
round(coalesce(sum(-val) FILTER (val < 0), 0), 4) AS false_positive_cost_usd, round(coalesce(sum(-net) FILTER (status = 'unchanged' AND net < 0), 0), 4) AS false_negative_loss_usd FROM final""")
def a32_backtest_report(spark, d):
    return overlay.report(overlay.replay(v.trades(spark, d), scored(spark, d), HOURLY))


EQUITY_SQL = ", line AS (SELECT *, sum(net) OVER w AS cumulative, max(net_sum) OVER w AS high FROM (SELECT *, sum(net) OVER (ORDER BY exit_ts_utc, trade_id) AS net_sum FROM profits) WINDOW w AS (ORDER BY exit_ts_utc, trade_id))"


def _with_pnl(spark, d):
    return v.trades(spark, d).withColumn("net", overlay.pnl(F.col("contracts"), HOURLY, costs=True))


@query(f"WITH {BASE_SQL} {TRADE_SQL} {EQUITY_SQL} SELECT trade_id, round(cumulative, 4) AS cumulative_pnl, round(50000 + cumulative, 4) AS equity, round(50000 + high, 4) AS running_high FROM line")
def w8_equity(spark, d):
    out = overlay.equity(_with_pnl(spark, d), "net", HOURLY)
    return out.select("trade_id", *(F.round(c, 4).alias(c) for c in ("cumulative_pnl", "equity", "running_high")))


@query(f"WITH {BASE_SQL} {TRADE_SQL} {EQUITY_SQL} SELECT (SELECT count(*) FROM (SELECT round(sum(net), 6) AS p FROM profits GROUP BY exit_ts_utc::DATE) WHERE p <= -50) AS daily_loss_breaches, count(*) FILTER (round(cumulative, 6) <= -500) AS maximum_loss_breaches, count(*) FILTER (round(high - cumulative, 6) >= 250) AS trailing_drawdown_breaches FROM line")
def a33_account_breaches(spark, d):
    return overlay.breaches(_with_pnl(spark, d), "net", HOURLY)


@query(f"""WITH {BASE_SQL} {rules_sql()} {RISK_SQL}, directed AS (SELECT *, CASE WHEN lvl IN ('SOFT_RISK', 'HARD_KILL') OR confidence < 0.58 THEN 'NO_TRADE' WHEN sentiment = 'bullish_market' THEN 'BULLISH' WHEN sentiment = 'bearish_market' THEN 'BEARISH' WHEN sentiment = 'geopolitical_risk' THEN 'NO_TRADE' ELSE 'NEUTRAL' END AS direction FROM timed)
SELECT post_id, direction AS direction_signal, CASE WHEN lvl = 'HARD_KILL' THEN 'BLOCK_NEW_ENTRIES' WHEN lvl = 'SOFT_RISK' THEN 'REDUCE_SIZE' WHEN direction = 'NO_TRADE' THEN 'BLOCK_NEW_ENTRIES' ELSE 'ALLOW' END AS action, CASE WHEN lvl = 'HARD_KILL' THEN 0.0 WHEN lvl = 'SOFT_RISK' THEN 0.5 WHEN direction = 'NO_TRADE' THEN 0.0 ELSE 1.0 END::DOUBLE AS risk_multiplier,
CASE WHEN lvl = 'HARD_KILL' THEN 3600 WHEN lvl = 'SOFT_RISK' THEN 1800 ELSE 900 END AS ttl_seconds, CASE WHEN lvl IN ('SOFT_RISK', 'HARD_KILL') THEN 'no_trade_whipsaw' ELSE tradeability END AS tradeability_label, 2000::BIGINT AS feed_lag_ms FROM directed""")
def f22_signals(spark, d):
    out = signals.signals(scored(spark, d, context=True).withColumn("received_at_utc", F.col("received_at_utc")), HOURLY)
    return out.select("post_id", "direction_signal", "kill_switch.action", "kill_switch.risk_multiplier", "kill_switch.ttl_seconds", "tradeability_label", "data_quality.feed_lag_ms")


@query(f"WITH {BASE_SQL} {rules_sql()} {RISK_SQL} SELECT post_id, lvl AS whipsaw_risk_level FROM timed ORDER BY received_at_utc DESC, post_id DESC LIMIT 1")
def t3_latest_signal(spark, d):
    return signals.latest(signals.signals(scored(spark, d, context=True), HOURLY)).select("post_id", "risk.whipsaw_risk_level")


@query(f"WITH {BASE_SQL} {rules_sql()} {RISK_SQL} SELECT post_id AS event_id, 'whipsaw_score' AS metric, score AS value FROM timed UNION ALL SELECT post_id, 'feed_lag_ms', 2000 FROM timed UNION ALL SELECT post_id, 'risk_multiplier', CASE WHEN lvl = 'HARD_KILL' THEN 0 WHEN lvl = 'SOFT_RISK' THEN 0.5 WHEN confidence < 0.58 OR sentiment = 'geopolitical_risk' THEN 0 ELSE 1 END FROM timed")
def f28_signal_gauges(spark, d):
    return signals.gauges(signals.signals(scored(spark, d, context=True), HOURLY))


@query(f"WITH {BASE_SQL} SELECT (max(received_at_utc) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 SECOND) OR false AS provider_stale FROM posts")
def f25_provider_stale(spark, d):
    late = F.max("received_at_utc") < F.expr("timestamp'2024-01-31 00:00:00' - interval 10 seconds")
    health = v.posts(spark, d).agg(late.alias("is_stale")).select(F.lit("events").alias("source"), "is_stale", F.lit(True).alias("is_healthy"))
    return signals.stale_flag(health, ["events"])




@query(f"WITH {BASE_SQL} {rules_sql()} {RISK_SQL} SELECT post_id, {NAMES}[list_position({VALUES}, list_max({VALUES}))] || '=' || printf('%.2f', round(list_max({VALUES})::DECIMAL(18, 6), 2)::DOUBLE) || coalesce('; prior=' || prior, '') AS reason FROM timed")
def f16_reasons(spark, d):
    return scored(spark, d).select("post_id", F.col("whipsaw_reason").alias("reason"))


@query(f"""WITH {BASE_SQL}, given AS (SELECT post_id, value / 1000 AS up, 0.25::DOUBLE AS down, 1::DOUBLE / 3 AS flat, value FROM posts)
SELECT post_id, round(up / (up + down + flat), 6) AS up_5m, round(down / (up + down + flat), 6) AS down_5m, round(flat / (up + down + flat), 6) AS flat_5m, 0.333333::DOUBLE AS up_15m, 0.333333::DOUBLE AS flat_30m, round(value - 10, 6) AS delta_5m, 0::DOUBLE AS delta_15m FROM given""")
def f23_direction_odds(spark, d):
    """Probabilities of a model for 5 minutes, one of them missing, none for 15, and nothing but zeros for 30."""
    none = {f"p_{x}_30m": F.lit(0.0) for x in ("up", "down", "flat")}
    given = scored(spark, d, context=True).withColumns({"p_up_5m": F.col("value") / 1000, "p_down_5m": F.lit(0.25), "p_flat_5m": F.lit(None).cast("double"), "expected_delta_5m_ticks": F.col("value") - 10} | none)
    out, odds, deltas = signals.signals(given, HOURLY), F.col("p_direction"), F.col("expected_delta_ticks")
    return out.select("post_id", *(odds[k].alias(k) for k in ("up_5m", "down_5m", "flat_5m", "up_15m", "flat_30m")), F.round(deltas["5m"], 6).alias("delta_5m"), deltas["15m"].alias("delta_15m"))
