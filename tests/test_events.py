import hashlib
import math
from datetime import timedelta

import market
import pytest

from tideline.functions.rules import classify, enrich
from tideline.operators.events import build_events, iso



def expected(post_id, received):
    """An event by plain scans of the bars; None where a bar is missing."""
    rows = market.bar_rows()
    after = [r for r in rows if r[0] >= received]
    if not after:
        return None
    start, base = after[0][0], after[0][1]
    out = {"aligned_bar_ts_utc": start, "base_price": base, "event_id": hashlib.sha256(f"{post_id}|{start.isoformat()}+00:00".encode()).hexdigest()[:16]}
    for h in (5, 15, 30):
        ends = [r for r in rows if r[0] >= start + timedelta(minutes=h)]
        if not ends:
            return None
        inside = [r for r in rows if start <= r[0] <= ends[0][0]]
        delta = (ends[0][4] - base) / 0.25
        out |= {
            f"nq_delta_{h}m_ticks": delta,
            f"nq_direction_{h}m": "up" if delta >= 4 else "down" if delta <= -4 else "flat",
            f"max_favourable_excursion_{h}m_ticks": max((max(r[2] for r in inside) - base) / 0.25, 0),
            f"max_adverse_excursion_{h}m_ticks": max((base - min(r[3] for r in inside)) / 0.25, 0),
            f"realised_range_{h}m_ticks": (max(r[2] for r in inside) - min(r[3] for r in inside)) / 0.25,
            f"realised_volatility_{h}m_ticks": round(math.sqrt(sum(((y[4] - x[4]) / 0.25) ** 2 for x, y in zip(inside, inside[1:], strict=False))), 4),
        }
    window = [r for r in rows if start <= r[0] <= start + timedelta(minutes=30)]
    first = [r for r in window if r[0] <= start + timedelta(minutes=10)]
    up, down = (max(r[2] for r in first) - base) / 0.25, (base - min(r[3] for r in first)) / 0.25
    if up >= down:
        top = max(range(len(window)), key=lambda i: window[i][2])
        back = (window[top][2] - min(r[3] for r in window[top:])) / 0.25
    else:
        top = min(range(len(window)), key=lambda i: window[i][3])
        back = (max(r[2] for r in window[top:]) - window[top][3]) / 0.25
    out["market_whipsaw_flag"] = max(up, down) >= 20 and back >= max(0.65 * max(up, down), 15)
    return out


@pytest.fixture(scope="module")
def built(spark):
    """Post b comes in two versions under one id, one post has no time, and two have too few bars after them."""
    rows = [*market.POSTS, ("b", "09:10:10", "A deal will come, growth! (edited)"), ("x", None, "never received"), *market.LATE]
    events, skipped = build_events(market.posts(spark, rows), market.bars(spark), market.calendar(spark))
    return events.collect(), skipped.collect()


def test_events_are_those_of_plain_scans(built):
    events, _ = built
    assert sorted((e["post_id"], f"{e['received_at_utc']:%H:%M:%S}") for e in events) == sorted([(i, t) for i, t, _ in market.POSTS] + [("b", "09:10:10")])
    for e in events:
        want = expected(e["post_id"], e["received_at_utc"])
        assert {k: e[k] for k in want} == want
    assert len({e["event_id"] for e in events}) == 5
    assert [e["market_whipsaw_flag"] for e in sorted(events, key=lambda e: e["received_at_utc"])] == [True, True, True, False, False]


def test_skipped_posts_have_reasons(built):
    assert {r["post_id"]: r["reason"] for r in built[1]} == {"x": "no_received_at", "e": "insufficient_forward_bars", "f": "no_market_bar_after_received_at"}


def test_nearest_calendar_event(built):
    got = {(e["post_id"], e["received_at_utc"].second): e for e in built[0]}
    assert (got["c", 0]["nearest_macro_event_id"], got["c", 0]["minutes_to_nearest_macro_event"], got["c", 0]["is_macro_blackout"]) == ("vote", 15.0, True)
    assert (got["d", 15]["nearest_macro_event_type"], got["d", 15]["minutes_to_nearest_macro_event"]) == ("vote", 8.75)
    # half past eight is 35.5 minutes before, the vote 34.5 minutes after
    assert (got["a", 30]["nearest_macro_event_id"], got["a", 30]["is_macro_blackout"]) == ("vote", False)


def test_one_cluster(built):
    events = sorted(built[0], key=lambda e: e["received_at_utc"])
    assert {e["event_cluster_size"] for e in events} == {5} and [e["event_cluster_position"] for e in events] == [0, 1, 2, 3, 4]
    first = events[0]
    name = f"cluster|{first['event_id']}|2025-03-04T09:05:30+00:00|30"
    assert {e["event_cluster_id"] for e in events} == {hashlib.sha256(name.encode()).hexdigest()[:16]}


def test_ids_dont_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp_micros(1735689599250000) as a, timestamp_micros(-1) as b, timestamp_micros(1735689600000000) as c, cast(null as timestamp) as d")
    try:
        for zone in ("America/New_York", "Asia/Kathmandu", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert list(df.select(*(iso(df[c]).alias(c) for c in "abcd")).first()) == ["2024-12-31T23:59:59.250000+00:00", "1969-12-31T23:59:59.999999+00:00", "2025-01-01T00:00:00+00:00", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rules(spark):
    texts = [("1", "Steel tariff now"), ("2", "again and again"), ("3", "S&P 500, s&p!"), ("4", "the markets"), ("5", "Oil prices; IRAN."), ("6", None), ("7", "élan_ai ai-based")]
    got = {r["post_id"]: r for r in classify(spark.createDataFrame(texts, "post_id string, text_clean string")).collect()}
    assert (got["1"]["rule_sentiment_label"], got["1"]["rule_topic_labels"], got["1"]["rule_reason_codes"]) == ("bearish_market", ["trade_policy", "china_tariffs"], ["bearish:tariff"])
    assert got["1"]["rule_sentiment_confidence"] == round(0.55 + 0.1 + 0.15 * 0.65, 4) and got["1"]["rule_topic_confidence"] == {"trade_policy": 0.65, "china_tariffs": 0.65}
    assert got["2"]["rule_topic_labels"] == got["4"]["rule_topic_labels"] == got["6"]["rule_topic_labels"] == ["other"]
    assert got["3"]["rule_topic_labels"] == ["equities_direct"] and got["3"]["rule_topic_confidence"] == {"equities_direct": 0.8}
    assert got["5"]["rule_topic_labels"] == ["iran_energy", "inflation_rates", "middle_east_geopolitics"] and got["5"]["rule_tradeability_label"] == "volatility_only"
    assert got["7"]["rule_topic_labels"] == ["technology_ai_semiconductors"]


def test_enrich(spark):
    rows = [("A  B!?", "A B!?", ["https://X.com:8/a?b", "http://x.com:8", None]), (None, None, None)]
    got = enrich(spark.createDataFrame(rows, "text_raw string, text_clean string, urls array<string>")).collect()
    assert (got[0]["url_domains"], got[0]["token_count"], got[0]["all_caps_ratio"], got[0]["exclamation_count"], got[0]["question_mark_count"]) == (["x.com:8"], 2, 1.0, 1, 1)
    assert (got[1]["url_domains"], got[1]["post_length"], got[1]["rule_sentiment_label"]) == ([], 0, "low_confidence")
