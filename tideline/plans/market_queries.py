"""Queries over posts and bars: alignment, targets, clusters, macro context, studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import risk, study
from . import views as v
from .views import ALIGNED_SQL, BASE_SQL, HOURLY, rules_sql, text_ts

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(f"WITH {ALIGNED_SQL} SELECT post_id, {STAMP.format('aligned_ts')} AS aligned_bar_ts_utc, base_price FROM aligned")
def j1_forward_asof(spark, d):
    out = ev.align(v.posts(spark, d), v.bars(spark, d))
    return out.select("post_id", text_ts("aligned_bar_ts_utc"), "base_price")


def _moves(spark, d):
    return ev.post_moves(v.posts(spark, d), v.bars(spark, d), HOURLY)


@query(f"WITH {ALIGNED_SQL} SELECT post_id, horizon, {STAMP.format('target_ts')} AS target_ts, delta_ticks, CASE WHEN delta_ticks >= 4 THEN 'up' WHEN delta_ticks <= -4 THEN 'down' WHEN delta_ticks IS NOT NULL THEN 'flat' END AS direction FROM target")
def j2_horizon_targets(spark, d):
    """The flagship: posts, the bars that follow them, and the move over each horizon."""
    out = ev.horizon_targets(_moves(spark, d), HOURLY)
    return out.select("post_id", "horizon", text_ts("target_ts"), "delta_ticks", F.when(F.col("delta_ticks").isNotNull(), ev.direction(F.col("delta_ticks"))).alias("direction"))


@query(f"WITH {ALIGNED_SQL} SELECT * FROM windowed")
def j3_window_targets(spark, d):
    return ev.window_targets(_moves(spark, d), HOURLY).drop("aligned_bar_ts_utc", "base_price", "target_ts")


@query(f"WITH {ALIGNED_SQL} SELECT * FROM flagged")
def j4_whipsaw_flags(spark, d):
    return _moves(spark, d).select("post_id", "market_whipsaw_flag")


@query(f"WITH {ALIGNED_SQL} SELECT post_id, c.event_id AS nearest_macro_event_id, c.event_type AS nearest_macro_event_type, c.importance AS nearest_macro_event_importance, round(m, 4) AS minutes_to_nearest_macro_event, coalesce(m BETWEEN -15 AND 15, false) AS is_macro_blackout FROM macro")
def j5_macro_context(spark, d):
    out = ev.macro_context(v.posts(spark, d), v.calendar(spark, d), HOURLY)
    return out.select("post_id", "nearest_macro_event_id", "nearest_macro_event_type", "nearest_macro_event_importance", "minutes_to_nearest_macro_event", "is_macro_blackout")


@query(f"WITH {ALIGNED_SQL} SELECT post_id, event_id, market_whipsaw_flag, tradeability_label, d60, d180, d360, r360, v360 FROM evt")
def p10_event_labels(spark, d):
    events, _ = v.event_frame(spark, d)
    return events.select("post_id", "event_id", "market_whipsaw_flag", "tradeability_label", *(F.col(f"nq_delta_{h}m_ticks").alias(f"d{h}") for h in HOURLY.horizons), F.col("realised_range_360m_ticks").alias("r360"), F.col("realised_volatility_360m_ticks").alias("v360"))


CLUSTER_SQL = ALIGNED_SQL + """,
clustered AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS size, row_number() OVER (PARTITION BY cluster ORDER BY received_at_utc, post_id) - 1 AS position,
  substr(sha256('cluster|' || first_value(event_id) OVER (PARTITION BY cluster ORDER BY received_at_utc, post_id) || '|' || """ + v.iso_sql("first_value(received_at_utc) OVER (PARTITION BY cluster ORDER BY received_at_utc, post_id)") + """ || '|360'), 1, 16) AS cluster_id FROM numbered)"""


@query(f"WITH {CLUSTER_SQL} SELECT post_id, cluster::BIGINT AS event_cluster_number, size AS event_cluster_size, position AS event_cluster_position, cluster_id AS event_cluster_id, round(since / 60000000.0, 4) AS minutes_since_previous_event, round(until / 60000000.0, 4) AS minutes_until_next_event, coalesce(since <= 21600000000, false) AS overlaps_prior_event_window, coalesce(until <= 21600000000, false) AS overlaps_next_event_window, size = 1 AS is_isolated_event, size > 1 AS is_burst_event FROM clustered")
def w1_clusters(spark, d):
    events, _ = v.event_frame(spark, d)
    return events.select("post_id", "event_cluster_number", "event_cluster_size", "event_cluster_position", "event_cluster_id", "minutes_since_previous_event", "minutes_until_next_event", "overlaps_prior_event_window", "overlaps_next_event_window", "is_isolated_event", "is_burst_event")


@query(f"WITH {ALIGNED_SQL} SELECT CASE WHEN aligned_ts IS NULL THEN 'no_market_bar_after_received_at' ELSE 'insufficient_forward_bars' END AS reason, count(*) AS n FROM aligned WHERE post_id NOT IN (SELECT post_id FROM evt) GROUP BY 1")
def j9_skipped_posts(spark, d):
    _, skipped = v.event_frame(spark, d)
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {ALIGNED_SQL} SELECT count(*) AS event_count, count(*) FILTER (market_whipsaw_flag) AS market_whipsaw_count FROM evt")
def a5_event_totals(spark, d):
    return study.totals(v.event_frame(spark, d)[0])


@query(f"WITH {ALIGNED_SQL} SELECT tradeability_label AS label, count(*) AS n FROM evt GROUP BY 1")
def a5_label_counts(spark, d):
    return study.label_counts(v.event_frame(spark, d)[0], "tradeability_label")


SUMMARY = """count(x) AS n, round(avg(x), 4) AS mean_ticks, round(median(x), 4) AS median_ticks, round(stddev_pop(x), 4) AS std_ticks, round(coalesce(stddev_samp(x), 0) / sqrt(count(x)), 4) AS standard_error_ticks,
round(avg(x) - 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(x)), 4) AS ci_low_ticks, round(avg(x) + 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(x)), 4) AS ci_high_ticks, round(quantile_cont(x, 0.1), 4) AS p10_ticks, round(quantile_cont(x, 0.9), 4) AS p90_ticks,
round(avg((x > 4)::INT), 6) AS positive_rate, round(avg((x < -4)::INT), 6) AS negative_rate, round(avg((x BETWEEN -4 AND 4)::INT), 6) AS flat_rate,
CASE WHEN round(avg(x) - 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(x)), 4) > 0 THEN 'positive_mean_move' WHEN round(avg(x) + 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(x)), 4) < 0 THEN 'negative_mean_move' WHEN abs(round(avg(x), 4)) <= 4 THEN 'no_clear_direction' ELSE 'directionally_uncertain' END AS interpretation"""
DELTAS = [f"nq_delta_{h}m_ticks" for h in HOURLY.horizons]
LONG_SQL = ", long AS (" + " UNION ALL ".join(f"SELECT post_id, 'nq_delta_{h}m_ticks' AS target, d{h} AS x FROM evt" for h in HOURLY.horizons) + ")"


@query(f"WITH {ALIGNED_SQL} {LONG_SQL} SELECT target, {SUMMARY} FROM long GROUP BY 1")
def a6_target_summary(spark, d):
    return study.target_summary(v.event_frame(spark, d)[0], DELTAS)


PREFIXES = {"nq_delta": "delta_ticks", "max_favourable_excursion": "mfe_ticks", "max_adverse_excursion": "mae_ticks", "realised_range": "range_ticks", "realised_volatility": "volatility_ticks"}


@query(f"WITH {ALIGNED_SQL} SELECT target || '_' || horizon::VARCHAR || 'm_ticks' AS target, {SUMMARY} FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS target, horizon, {c} AS x FROM windowed WHERE post_id IN (SELECT post_id FROM evt)" for p, c in PREFIXES.items()) + ") GROUP BY target, horizon")
def a9_all_targets(spark, d):
    return study.target_summary(v.event_frame(spark, d)[0], [f"{p}_{h}m_ticks" for p in PREFIXES for h in HOURLY.horizons])


@query(f"WITH {ALIGNED_SQL} SELECT tradeability_label AS label, count(*) AS n, round(avg(d360), 4) AS mean_ticks, round(avg(r360), 4) AS mean_range_ticks, round(avg(v360), 4) AS mean_volatility_ticks FROM evt GROUP BY 1")
def a10_segments(spark, d):
    return study.segments(v.event_frame(spark, d)[0], "tradeability_label", "nq_delta_360m_ticks", "realised_range_360m_ticks", "realised_volatility_360m_ticks")


def labelled(spark, d):
    return v.labelled(v.event_frame(spark, d, numbered=True)[0], spark, d)


@query(f"WITH {ALIGNED_SQL} {rules_sql()} {LONG_SQL} SELECT l.sentiment AS rule_sentiment_label, g.target, {SUMMARY} FROM long g JOIN labelled l ON l.post_id = g.post_id GROUP BY 1, 2")
def a11_sentiment_segments(spark, d):
    return study.target_summary(labelled(spark, d), DELTAS, by=["rule_sentiment_label"])


@query(f"WITH {ALIGNED_SQL} {rules_sql()} {LONG_SQL} SELECT l.topic, g.target, {SUMMARY} FROM long g JOIN (SELECT post_id, unnest(topics) AS topic FROM labelled) l ON l.post_id = g.post_id GROUP BY 1, 2")
def a12_topic_segments(spark, d):
    return study.target_summary(study.topic_rows(labelled(spark, d)), DELTAS, by=["topic"])


@query(f"WITH {CLUSTER_SQL}, sizes AS (SELECT cluster, count(*) AS size FROM clustered GROUP BY 1), per AS (SELECT size, count(*) AS clusters, sum(size)::BIGINT AS events FROM sizes GROUP BY 1) SELECT per.*, t.* FROM per, (SELECT sum(clusters)::BIGINT AS cluster_count, coalesce(sum(events) FILTER (size = 1), 0)::BIGINT AS isolated_events, coalesce(sum(events) FILTER (size > 1), 0)::BIGINT AS burst_events, max(size) AS max_size FROM per) t")
def a13_cluster_summary(spark, d):
    return study.cluster_summary(v.event_frame(spark, d)[0])


@query(f"WITH {ALIGNED_SQL} SELECT coalesce(c.event_type, 'none') AS macro_type, count(*) AS n, count(*) FILTER (m BETWEEN -15 AND 15) AS blackout FROM evt LEFT JOIN macro USING (post_id) GROUP BY 1")
def a14_macro_summary(spark, d):
    return study.macro_summary(v.event_frame(spark, d, macro=True)[0])


@query(f"WITH {BASE_SQL} SELECT post_id, {STAMP.format('received_at_utc')} AS received_at_utc, author_id FROM posts ORDER BY received_at_utc DESC, post_id DESC LIMIT 10")
def t6_last_posts(spark, d):
    """Ten rows are what this report shows."""
    return v.posts(spark, d).orderBy(F.desc("received_at_utc"), F.desc("post_id")).limit(10).select("post_id", text_ts("received_at_utc"), "author_id")


EDITED_SQL = f"""{BASE_SQL},
edited AS (SELECT (user_id % 500)::VARCHAR AS post_id, event_id AS version, CASE WHEN event_id % 97 <> 0 THEN ts + INTERVAL 250 MILLISECOND END AS received_at_utc FROM events WHERE event_type = 'signup' AND ts IS NOT NULL),
placed AS (SELECT e.*, b.ts_open_utc AS aligned_ts FROM edited e ASOF LEFT JOIN bars b ON e.received_at_utc <= b.ts_open_utc),
whole AS (SELECT p.*, row_number() OVER (ORDER BY received_at_utc, version) AS n FROM placed p ASOF JOIN bars b ON p.aligned_ts + INTERVAL 360 MINUTE <= b.ts_open_utc WHERE p.aligned_ts IS NOT NULL)"""


def edited_posts(spark, d):
    """Sign-ups as versions of posts: ids come again, times have fractions, and some rows have no time."""
    rows = v.events(spark, d).where("event_type = 'signup'")
    at = F.when(F.col("event_id") % 97 != 0, F.timestamp_micros(F.unix_micros("ts") + 250_000))
    return rows.select((F.col("user_id") % 500).cast("string").alias("post_id"), F.col("event_id").alias("version"), at.alias("received_at_utc"))


@query(f"""WITH {EDITED_SQL} SELECT version, substr(sha256(post_id || '|' || {v.iso_sql('aligned_ts')}), 1, 16) AS event_id, {v.iso_sql('received_at_utc')} AS received FROM whole""")
def f17_edited_events(spark, d):
    """Every version of a post has its own event; ids and times are of the instant in UTC."""
    events, _ = ev.build_events(edited_posts(spark, d), v.bars(spark, d), None, HOURLY)
    return events.select("version", "event_id", ev.iso(F.col("received_at_utc")).alias("received"))


@query(f"""WITH {EDITED_SQL} SELECT CASE WHEN received_at_utc IS NULL THEN 'no_received_at' WHEN aligned_ts IS NULL THEN 'no_market_bar_after_received_at' ELSE 'insufficient_forward_bars' END AS reason, count(*) AS n FROM placed WHERE version NOT IN (SELECT version FROM whole) GROUP BY 1""")
def j9_skipped_versions(spark, d):
    _, skipped = ev.build_events(edited_posts(spark, d), v.bars(spark, d), None, HOURLY)
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {EDITED_SQL}, since AS (SELECT version, (epoch_us(received_at_utc) - lag(epoch_us(received_at_utc)) OVER (ORDER BY received_at_utc, version)) / 60000000.0 AS gap FROM edited WHERE received_at_utc IS NOT NULL)
SELECT version, round(coalesce(gap, 1440), 4) AS minutes_since_previous_post FROM since UNION ALL SELECT version, 1440 FROM edited WHERE received_at_utc IS NULL""")
def w7_timing_versions(spark, d):
    """Rows without a time are kept."""
    out = risk.timing_features(edited_posts(spark, d), tie="version")
    return out.select("version", F.round("minutes_since_previous_post", 4).alias("minutes_since_previous_post"))
