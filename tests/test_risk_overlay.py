import market
import pytest
from pyspark.sql import functions as F

from tideline.functions.rules import classify
from tideline.operators import overlay, risk, signals, study, temporal, tuning
from tideline.operators.events import build_events
from tideline.operators.labels import agreement, audit_reviews, check_reviews, label_queue, review_counts


@pytest.fixture(scope="module")
def scored(spark):
    events, _ = build_events(market.posts(spark), market.bars(spark), market.calendar(spark))
    out = risk.score(classify(events)).persist()
    yield out
    out.unpersist()


def test_scores_and_levels(scored):
    """a: 0.35 + 0.3 * 0.8; b: 0.07 + 0.18 + 0.15 * 0.7 + 0.015 + 0.1 / 3 + 0.07; c: 0.35 + 0.24 + 0.06 + 0.2 / 3 + 0.07; d: 0.1."""
    got = {r["post_id"]: r for r in scored.collect()}
    assert [got[i]["whipsaw_score"] for i in "abcd"] == [0.59, 0.473333, 0.786667, 0.1]
    assert [got[i]["whipsaw_risk_level"] for i in "abcd"] == ["SOFT_RISK", "WATCH", "HARD_KILL", "NONE"]
    assert [got[i]["risk_ttl_seconds"] for i in "abcd"] == [1800, 900, 3600, 0]
    assert [got[i]["contradicting_post_ids"] for i in "abcd"] == [[], ["a"], ["b"], []]
    assert [got[i]["whipsaw_reason"] for i in "abcd"] == ["headline_risk_score=1.00", "direction_flip_score=1.00; prior=a", "headline_risk_score=1.00; prior=b", "post_burst_score=1.00"]
    row = risk.evaluate(scored).first()  # a and b are whipsaws, a and c are soft or harder
    assert (row["soft_tp"], row["soft_fp"], row["soft_tn"], row["soft_fn"], row["soft_precision"], row["soft_recall"]) == (1, 1, 1, 1, 0.5, 0.5)
    assert (row["hard_fp"], row["hard_precision"], row["hard_recall"]) == (1, 0.0, 0.0)
    assert row["mean_score_true"] == pytest.approx(1.063333 / 2, abs=1e-6) and row["mean_score_false"] == pytest.approx(0.886667 / 2, abs=1e-6)


def test_versions_of_a_post_are_scored_apart(spark):
    rows = [("p", "09:00:00", "tariff"), ("p", "09:10:00", "growth"), ("q", "09:20:00", "thank you")]
    got = {r["received_at_utc"].minute: r for r in risk.score(classify(market.posts(spark, rows))).collect()}
    assert len(got) == 3 and [got[m]["post_burst_score"] for m in (0, 10, 20)] == [0.0, 0.333333, 0.666667]
    assert [got[m]["text_contradiction_score"] for m in (0, 10, 20)] == [0.0, 0.4, 0.0]


def test_scores_without_context(spark):
    """Instants with several posts, and a post without a time: the score's own columns are the same, the others are left out."""
    texts = ["tariff", "growth", "tariff china", "thank you", "rally"]
    rows = [(f"p{i}", f"09:{i // 3 * 7:02}:00", texts[i % 5]) for i in range(18)]
    posts = classify(market.posts(spark, rows)).withColumn("received_at_utc", F.expr("CASE WHEN post_id <> 'p4' THEN received_at_utc END"))
    lean, whole = risk.score(posts, context=False), risk.score(posts)
    assert set(whole.columns) - set(lean.columns) == {"topic_entropy_60m", "minutes_since_previous_post", "expected_minutes_to_next_post", *(f"p_next_post_{h}m" for h in (15, 30, 60)), *(f"posts_last_{m}m" for m in (5, 15, 30, 240))}
    assert sorted(map(str, lean.collect())) == sorted(map(str, whole.select(lean.columns).collect()))


def test_scans_have_a_row_for_each_instant_not_for_each_post(spark, monkeypatch):
    """Twenty posts of each instant and text ask what one of them asks, and get the same scores."""
    texts, sizes = ["tariff", "growth", "tariff china", "thank you", "rally"], []
    rows = [(f"p{i}", f"09:{i * 4:02}:00", texts[i % 5]) for i in range(15)]
    ranged = temporal.ranged

    def counted(df, order):
        sizes.append(df.count())
        return ranged(df, order)

    monkeypatch.setattr(temporal, "ranged", counted)
    once = classify(market.posts(spark, rows))
    found = []
    for n in (1, 20):
        copies = once.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("_copy")
        found.append({tuple(r) for r in risk.score(copies, context=False).select("post_id", "text_contradiction_score", "same_topic_score", "direction_flip_score", "contradicting_post_ids").withColumn("contradicting_post_ids", F.col("contradicting_post_ids").cast("string")).collect()})
    assert found[0] == found[1]
    assert len(sizes) > 2 and sizes[: len(sizes) // 2] == sizes[len(sizes) // 2 :]


def test_replay(spark, scored):
    out = overlay.replay(market.trades(spark), scored)
    assert {r["trade_id"]: (r["contracts_after"], r["kill_switch_status"], r["attribution_label"]) for r in out.collect()} == {"t1": (1, "reduced", "helpful_risk_reduction"), "t2": (0, "filtered", "false_positive_cost"), "t3": (1, "unchanged", "false_negative_loss")}
    row = overlay.report(out).first()
    assert (row["net_pnl_before_usd"], row["net_pnl_after_usd"], row["kill_switch_value_usd"]) == (-35.42, -19.46, 15.96)
    assert (row["avoided_losing_trade_usd"], row["missed_winning_trade_usd"], row["false_positive_cost_usd"], row["false_negative_loss_usd"]) == (0.0, 0.52, 0.52, 2.98)
    assert tuple(overlay.breaches(out, "net_pnl_before_usd").first()) == (0, 0, 0)


def test_latest_signal(scored):
    row = signals.latest(signals.signals(scored)).first()
    assert row["post_id"] == "d" and row["kill_switch"]["action"] == "ALLOW" and row["kill_switch"]["reason_codes"] == []
    assert row["p_direction"]["up_5m"] == 0.333333 and row["expected_delta_ticks"]["30m"] == 0.0
    stale = signals.latest(signals.signals(scored, provider_stale=True)).first()
    assert stale["direction_signal"] == "NO_TRADE" and stale["kill_switch"]["reason_codes"] == ["NO_TRADE_DATA_STALE"]
    given = scored.withColumns({"p_up_5m": F.lit(2.0), "p_down_5m": F.lit(1.0), "p_flat_5m": F.lit(1.0), "expected_delta_5m_ticks": F.lit(3)})
    row = signals.latest(signals.signals(given)).first()
    assert [row["p_direction"][f"{k}_5m"] for k in ("up", "down", "flat")] == [0.5, 0.25, 0.25] and row["expected_delta_ticks"]["5m"] == 3.0


def test_stale_without_report(spark):
    health = spark.createDataFrame([("a", False, True)], "source string, is_stale boolean, is_healthy boolean")
    assert not signals.stale_flag(health, ["a"]).first()[0]
    assert signals.stale_flag(health, ["a", "b"]).first()[0]


def test_cluster_and_macro_summary(scored):
    assert tuple(study.cluster_summary(scored).first()) == (4, 1, 4, 1, 0, 4, 4)
    assert {r["macro_type"]: (r["n"], r["blackout"]) for r in study.macro_summary(scored).collect()} == {"vote": (4, 2)}


def test_reviews(spark, scored):
    queue = label_queue(scored, 3)
    assert len(queue.columns) == 19 and queue.count() == 3 and not any("delta" in c for c in queue.columns)
    rows = [("e1", "p1", "bearish_market", "ambiguous", "trade_policy|other", "uncertain", "none", "0.8", r, "2026-06-12T12:00:00Z", "") for r in "ab"]
    names = ["event_id", "post_id", "human_sentiment_label", "human_tradeability_label", "human_topic_labels", "market_relevance_label", "contradiction_label", "label_confidence", "reviewer_id", "reviewed_at_utc", "review_notes"]
    good = check_reviews(spark.createDataFrame(rows, names), "v1")
    assert good.where(F.size("problems") > 0).isEmpty()
    assert tuple(audit_reviews(good).first()) == (2, 1, 0, 1)
    assert sorted(map(tuple, review_counts(good, ["reviewer_id", "human_sentiment_label"]).collect())) == [("human_sentiment_label", "bearish_market", 2), ("reviewer_id", "a", 1), ("reviewer_id", "b", 1)]
    assert agreement(good, ["human_sentiment_label"]).first()["unanimous_rate"] == 1.0
    bad = check_reviews(spark.createDataFrame([("e1", "p1", "glad", "ambiguous", "nonsense", "uncertain", "none", "1.8", "a", "2026-06-12T12:00:00", "")], names), "v1").first()["problems"]
    assert len(bad) == 4


def test_trials_meet_equal_rows_once(spark):
    """6,000 rows of three kinds: trials are copied to the kinds, with the same counts as for all rows."""
    scored = spark.range(6_000).select(*(F.lit(0.0).alias(c) for c in risk.COMPONENTS[1:]), (F.col("id") % 3 / 2).alias("headline_risk_score"), (F.col("id") % 3 == 2).alias("market_whipsaw_flag"))
    trial = tuning.Trial(1, {c: float(c == "headline_risk_score") for c in risk.COMPONENTS}, 0.5, 1.0)
    out = tuning.evaluate_trials(scored, [trial])
    row = out.first()
    assert (row["row_count"], row["soft_tp"], row["soft_fp"], row["soft_tn"], row["soft_fn"], row["soft_precision"], row["hard_tp"], row["hard_fp"], row["risk_prediction_rate"]) == (6_000, 2_000, 2_000, 2_000, 0, 0.5, 2_000, 0, 0.666667)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan[plan.index("Generate") :]
