"""Queries over model inputs, tuning, model comparison and the digests of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import enrich
from ..models import baselines
from ..operators import events as ev
from ..operators import labels, metrics, overlay, quality, reports, risk, tuning
from ..operators.temporal import MINUTE, cut
from . import views as v
from .market_queries import edited_posts
from .quality_queries import AUDIT, COVER, DOC_POSTS, FULL_BARS, REVIEWS, SQL as QUALITY_SQL, doc_posts
from .risk_queries import REPLAY_SQL, RISK_SQL, SQL as RISK_QUERIES, scored
from .views import ALIGNED_SQL, BASE_SQL, CORPUS_RULES, HOURLY, rules_sql

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FEATURE_SQL = f", features AS ({QUALITY_SQL['f4_text_features']})"


@query(f"WITH {BASE_SQL} {rules_sql()} {FEATURE_SQL} SELECT l.post_id, f.post_length::DOUBLE AS post_length, f.token_count::DOUBLE AS token_count, f.all_caps_ratio::DOUBLE AS all_caps_ratio, f.exclamation_count::DOUBLE AS exclamation_count, f.question_mark_count::DOUBLE AS question_mark_count, 0::DOUBLE AS has_image, 0::DOUBLE AS has_video, l.confidence AS rule_sentiment_confidence FROM labelled l JOIN posts p ON p.post_id = l.post_id JOIN features f ON f.doc_id = p.doc_id")
def p14_context_features(spark, d):
    rows = enrich(v.posts(spark, d, text=True), rules=CORPUS_RULES).withColumns({"has_image": F.lit(False), "has_video": F.lit(None).cast("boolean")})
    return baselines.context_features(rows, ["post_id"])


@query(f"WITH {BASE_SQL} {rules_sql()} SELECT l.post_id, 'x.y:8' AS domains, l.sentiment, length(coalesce(d.text, ''))::INTEGER AS post_length FROM labelled l JOIN posts p ON p.post_id = l.post_id LEFT JOIN documents d ON d.doc_id = p.doc_id")
def f12_enriched_posts(spark, d):
    """Addresses are given as text here: two of one host, one of none."""
    rows = v.posts(spark, d, text=True).withColumn("urls", F.lit("https://X.y:8/a|http://x.Y:8?b|none"))
    return enrich(rows, rules=CORPUS_RULES).select("post_id", F.array_join("url_domains", ",").alias("domains"), F.col("rule_sentiment_label").alias("sentiment"), "post_length")


@query(f"WITH {ALIGNED_SQL} SELECT label, row_number() OVER (ORDER BY label) - 1 AS index FROM (SELECT DISTINCT tradeability_label AS label FROM evt)")
def m9_label_index(spark, d):
    return baselines.label_index(v.event_frame(spark, d)[0]).withColumn("index", F.col("index").cast("long"))


@query(f"""WITH {ALIGNED_SQL}, full_bars AS (SELECT *, epoch_us(ts_open_utc) // 3600000000 % 50 <> 0 AS is_valid_bar FROM bars), good AS (SELECT * FROM full_bars WHERE is_valid_bar),
edited AS (SELECT CASE WHEN event_id % 97 <> 0 THEN ts + INTERVAL 250 MILLISECOND END AS received_at_utc FROM events WHERE event_type = 'signup' AND ts IS NOT NULL),
placed AS (SELECT e.*, b.ts_open_utc AS bar_ts FROM edited e ASOF LEFT JOIN good b ON e.received_at_utc <= b.ts_open_utc),
ended AS (SELECT p.*, b.ts_open_utc AS last FROM (SELECT *, bar_ts + INTERVAL 360 MINUTE AS until FROM placed) p ASOF LEFT JOIN good b ON p.until <= b.ts_open_utc),
judged AS (SELECT CASE WHEN received_at_utc IS NULL THEN 'no_received_at' WHEN bar_ts IS NULL THEN 'no_market_bar_after_received_at' WHEN last IS NULL THEN 'insufficient_forward_bars' END AS reason FROM ended)
SELECT 'input_post_count' AS measure, count(*) AS n FROM edited UNION ALL SELECT 'market_bar_count', count(*) FROM full_bars UNION ALL SELECT 'market_valid_bar_count', count(*) FROM good UNION ALL SELECT 'event_count', count(*) FROM judged WHERE reason IS NULL
UNION ALL SELECT 'skipped_post_count', count(reason) FROM judged UNION ALL SELECT 'skipped:' || reason, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY 1""")
def a21_event_build_audit(spark, d):
    """Every fiftieth bar is invalid here; posts are the versions of f17_edited_events."""
    posts, bars = edited_posts(spark, d), v.full_bars(spark, d)
    events, skipped = ev.build_events(posts, bars, None, HOURLY)
    return reports.event_build_audit(posts, bars, events, skipped)


def _audits(spark, d):
    return quality.audit_posts(doc_posts(spark, d)), quality.audit_bars(v.full_bars(spark, d), 60), labels.audit_reviews(v.reviews(spark, d))


@query(f"WITH {REVIEWS}, x AS (SELECT (SELECT count(*) FROM documents) >= 1000 AS a, (SELECT count(*) FROM reviews) >= 500 AS h) SELECT a AS real_post_archive_verified, true AS licensed_market_data_loaded, h AS human_label_minimum_met, h AS transformer_training_ready, CASE WHEN a AND h THEN 'real_research_ready' ELSE 'not_research_ready' END AS status, CASE WHEN a AND h THEN 'shadow_review_ready' ELSE 'fixture_shadow_only' END AS review_status FROM x")
def a36_readiness(spark, d):
    return reports.readiness(*_audits(spark, d))


@query(f"WITH {FULL_BARS}, {DOC_POSTS}, {REVIEWS}, p AS (SELECT {AUDIT} FROM doc_posts) SELECT p.row_count AS archive_post_rows, p.empty_text_rows AS archive_empty_text_rows, (SELECT count(*) FROM full_bars) AS market_rows, (SELECT count(*) FROM full_bars WHERE is_valid_bar) AS market_valid_rows, 'events' AS market_source_names, (SELECT count(*) FROM reviews) AS human_label_rows, (SELECT count(DISTINCT event_id) FROM reviews) AS human_label_unique_events FROM p")
def j13_data_quality(spark, d):
    return reports.data_quality(*_audits(spark, d))


@query(f"SELECT row_count, soft_precision, soft_recall, hard_precision, hard_recall FROM ({RISK_QUERIES['a25_whipsaw_evaluation']})")
def a37_whipsaw_digest(spark, d):
    return reports.whipsaw_digest(risk.evaluate(flagged(spark, d)))


@query(f"SELECT trade_count, net_pnl_before_usd, net_pnl_after_usd, kill_switch_value_usd, avoided_losing_trade_usd, missed_winning_trade_usd FROM ({RISK_QUERIES['a32_backtest_report']})")
def a37_backtest_digest(spark, d):
    return reports.backtest_digest(overlay.report(overlay.replay(v.trades(spark, d), scored(spark, d), HOURLY)))


def flagged(spark, d):
    """Scored posts with the market's whipsaw flag."""
    return scored(spark, d).join(ev.post_moves(v.posts(spark, d), v.bars(spark, d), HOURLY).select("post_id", "market_whipsaw_flag"), "post_id")


TRIALS = [tuning.DEFAULT_TRIAL, *tuning.random_trials(60, 42)]
PARTS = ["c_head", "c_rel", "c_text", "c_topic", "c_burst", "c_flip", "0"]
TRIAL_SQL = ", trials(trial, w, soft, hard) AS (VALUES " + ", ".join(f"({t.number}, {[float(t.weights[c]) for c in risk.COMPONENTS]}::DOUBLE[], {t.soft}::DOUBLE, {t.hard}::DOUBLE)" for t in TRIALS) + ")"
TRIAL_SCORE = "round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, " + " + ".join(f"t.w[{i + 1}] * {c}::DOUBLE" for i, c in enumerate(PARTS)) + ")), 9)"


@query(f"""WITH {ALIGNED_SQL} {rules_sql()} {RISK_SQL} {TRIAL_SQL}, tried AS (SELECT t.trial, f.market_whipsaw_flag AS w, {TRIAL_SCORE} >= t.soft AS s, {TRIAL_SCORE} >= t.hard AS h FROM timed r JOIN flagged f ON f.post_id = r.post_id, trials t),
counts AS (SELECT trial, count(*) AS row_count, count(*) FILTER (w AND s) AS soft_tp, count(*) FILTER (NOT w AND s) AS soft_fp, count(*) FILTER (NOT w AND NOT s) AS soft_tn, count(*) FILTER (w AND NOT s) AS soft_fn, count(*) FILTER (w AND h) AS hard_tp, count(*) FILTER (NOT w AND h) AS hard_fp, count(*) FILTER (NOT w AND NOT h) AS hard_tn, count(*) FILTER (w AND NOT h) AS hard_fn, round(avg(s::INT), 6) AS risk_prediction_rate FROM tried GROUP BY 1),
rated AS (SELECT *, coalesce(round(soft_tp / nullif(soft_tp + soft_fp, 0), 6), 0) AS soft_precision, coalesce(round(soft_tp / nullif(soft_tp + soft_fn, 0), 6), 0) AS soft_recall, coalesce(round(hard_tp / nullif(hard_tp + hard_fp, 0), 6), 0) AS hard_precision, coalesce(round(hard_tp / nullif(hard_tp + hard_fn, 0), 6), 0) AS hard_recall FROM counts)
SELECT *, round(0.40::DOUBLE * soft_recall + 0.25::DOUBLE * soft_precision + 0.20::DOUBLE * hard_precision + 0.10::DOUBLE * hard_recall - 0.05::DOUBLE * greatest(0::DOUBLE, risk_prediction_rate - 0.60::DOUBLE), 6) AS objective FROM rated""")
def m8_tuning_trials(spark, d):
    return tuning.evaluate_trials(flagged(spark, d), TRIALS)


def _model_rows(spark, d, *, context=True):
    """Labelled documents in order of id; context: with the features of their texts, and what these say of links and emphasis as the context flags."""
    docs = v.table(spark, d, "documents").select("doc_id", F.col("text").alias("text_clean"))
    rows = v.predictions(spark, d).select("doc_id", F.col("actual").alias("tradeability_label"), F.col("predicted").alias("rule_tradeability_label"))
    # documents without a label aren't classified
    rows = rows.join(docs, "doc_id").withColumn("received_at_utc", F.timestamp_micros(F.col("doc_id") * MINUTE))
    if context:
        text = F.coalesce("text_clean", F.lit(""))
        flags = {"has_image": text.contains("http"), "has_video": text.contains("!!")}
        rows = enrich(rows.withColumnRenamed("rule_tradeability_label", "_given").withColumns(flags), rules=CORPUS_RULES)
        rows = rows.drop("url_domains", "rule_topic_labels", "rule_topic_confidence", "rule_reason_codes", "rule_tradeability_label").withColumnRenamed("_given", "rule_tradeability_label")
    return cut(rows)


@query()
def m5_model_comparison(spark, d):
    """Naive, rules and all four models on all labelled documents in order of id; fits have no SQL."""
    return baselines.compare(_model_rows(spark, d), order=["received_at_utc", "doc_id"])


@query()
def m6_walk_forward(spark, d):
    """Folds over all labelled documents in order of id: a quarter trains the first, every further sixth is tested in turn."""
    rows = _model_rows(spark, d, context=False)
    n = rows.count()
    found = baselines.walk_forward(rows, order=["received_at_utc", "doc_id"], models=("tfidf_logreg", "tfidf_linear_svm"), first_train=max(2, n // 4), test_rows=max(1, n // 6), step=max(1, n // 6))
    labels = [r[0] for r in found.select("actual").distinct().orderBy("actual").limit(1_000).collect()]
    return metrics.walk_forward_summary(found, labels)
