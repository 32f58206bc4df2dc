"""Bucketed joins and windows, and what is built on them, against plain scans of random rows."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tideline.operators import overlay, risk, temporal, tiles
from tideline.config import Settings
from tideline.operators.events import clusters, post_moves, window_targets
from tideline.operators.temporal import forward_asof

START = datetime(2025, 1, 1)
LABELS = ["bullish_market", "bearish_market", "geopolitical_risk", "neutral"]


@pytest.fixture(scope="module")
def rows():
    """(number, id, time, topics, label): ids and times come again, one burst is dense, some rows have no time."""
    rng = random.Random(11)
    out = []
    for n in range(300):
        seconds = rng.randrange(3 * 86_400) if n % 3 else 40_000 + rng.randrange(5_400)
        time = None if n % 50 == 7 else START + timedelta(seconds=seconds // 60 * 60, milliseconds=rng.choice([0, 0, 250]))
        out.append((n, f"p{n % 120}", time, rng.sample(["x", "y", "z"], rng.randrange(3)), rng.choice(LABELS)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    schema = "n int, post_id string, received_at_utc timestamp, rule_topic_labels array<string>, rule_sentiment_label string"
    return spark.createDataFrame(rows, schema).withColumn("event_id", F.col("n").cast("string")).repartition(5)


def test_asof(spark, rows, frame):
    right = [(START + timedelta(hours=h),) for h in (1, 5, 6, 30, 31, 70)]
    out = forward_asof(frame.select("n", "received_at_utc"), spark.createDataFrame(right, "ts timestamp"), "received_at_utc", "ts")
    got = {r["n"]: r["match"] and r["match"]["ts"] for r in out.collect()}
    assert got == {n: next((t for (t,) in right if time and t >= time), None) for n, _, time, *_ in rows}


def test_bursts_and_entropy(rows, frame):
    got = {r["n"]: r for r in risk.burst_features(frame).collect()}
    assert len(got) == len(rows)
    for n, _, time, *_ in rows:
        prior = [r for r in rows if time and r[2] and time - timedelta(minutes=60) <= r[2] < time]
        counts = Counter(t for r in prior for t in r[3])
        total = sum(counts.values())
        assert math.isclose(got[n]["topic_entropy_60m"], -sum(c / total * math.log2(c / total) for c in counts.values()), abs_tol=2e-6)
        assert got[n]["posts_last_60m"] == len(prior)
        assert got[n]["posts_last_240m"] == sum(1 for r in rows if time and r[2] and time - timedelta(minutes=240) <= r[2] < time)


def test_timing(rows, frame):
    got = {r["n"]: r for r in risk.timing_features(frame, tie="n").collect()}
    assert len(got) == len(rows)
    order, gaps = sorted((r[2], r[0]) for r in rows if r[2]), []
    for i, (time, n) in enumerate(order):
        if i:
            gaps.append((time - order[i - 1][0]).total_seconds() / 60)
        assert math.isclose(got[n]["minutes_since_previous_post"], gaps[-1] if gaps else 1440)
        assert math.isclose(got[n]["expected_minutes_to_next_post"], sum(gaps) / len(gaps) if gaps else 1440, abs_tol=1e-4)
        assert math.isclose(got[n]["p_next_post_30m"], sum(g <= 30 for g in gaps) / len(gaps) if gaps else 0, abs_tol=1e-6)
    assert all(got[r[0]]["minutes_since_previous_post"] == 1440 and got[r[0]]["p_next_post_15m"] == 0 for r in rows if r[2] is None)


def _pair(a, b):
    way = {"bullish_market": 1, "bearish_market": -1, "geopolitical_risk": -1}
    opposed = way.get(a[4], 0) * way.get(b[4], 0) == -1
    shared = len(set(a[3]) & set(b[3])) / len(set(a[3]) | set(b[3])) if a[3] and b[3] else 0.0
    return (round(0.4 + 0.6 * shared, 4) if opposed else 0.0), shared, float(opposed)


def test_pair_scores(rows, frame):
    got = {r["n"]: r for r in risk.pair_scores(frame, key="n").collect()}
    for a in rows:
        prior = [(b, _pair(a, b)) for b in rows if a[2] and b[2] and a[2] - timedelta(minutes=60) <= b[2] < a[2]]
        if not prior:
            assert a[0] not in got
            continue
        texts = [(-s[0], b[2], b[1]) for b, s in prior if s[0] > 0]
        want = (max(s[0] for _, s in prior), round(max(s[1] for _, s in prior), 6), max(s[2] for _, s in prior), min(texts)[2] if texts else None)
        assert (got[a[0]]["text_contradiction_score"], got[a[0]]["same_topic_score"], got[a[0]]["direction_flip_score"], got[a[0]]["_prior"]) == want


def test_no_pairs_of_rows_in_the_plan(frame):
    plan = risk.pair_scores(frame, key="n")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pair_scores_write_few_rows_for_each_post(spark):
    """2,000 posts of 30 classes within two hours: a row for each post and class would be 60,000."""
    rng = random.Random(4)
    names = ["v", "w", "x", "y", "z"]
    rows = [(n, f"p{n}", START + timedelta(milliseconds=rng.randrange(7_200_000)), [t for i, t in enumerate(names) if n >> i & 1 and n % 10], rng.choice(LABELS)) for n in range(2_000)]
    df = spark.createDataFrame(rows, "n int, post_id string, received_at_utc timestamp, rule_topic_labels array<string>, rule_sentiment_label string")
    home = Path(temporal.shared_folder(spark))
    before = set(home.iterdir())
    assert risk.pair_scores(df, key="n").count() > 1_990
    assert sum(spark.read.parquet(str(p)).count() for p in set(home.iterdir()) - before if p.name.startswith("cut-")) < 4 * len(rows)


def test_clusters(rows, frame):
    got = {r["n"]: r for r in clusters(frame).collect()}
    assert len(got) == len(rows)
    order = sorted((r[2], r[1], str(r[0]), r[0]) for r in rows if r[2])
    number, members = 0, []
    for i, (time, *_, n) in enumerate(order):
        if i == 0 or time - order[i - 1][0] > timedelta(minutes=30):
            number += 1
            members.append([])
        members[-1].append(n)
    for k, group in enumerate(members):
        assert [(got[n]["event_cluster_number"], got[n]["event_cluster_size"], got[n]["event_cluster_position"]) for n in group] == [(k + 1, len(group), i) for i in range(len(group))]


def test_a_dense_instant_is_dealt_to_all_ranges(spark):
    one = spark.range(40_000).select(F.col("id"), F.lit(START).alias("ts"), F.lit("x" * 50).alias("text"))
    rows = temporal.ranged(one.select("id", "ts"), ["ts", "id"])
    assert rows.columns == ["id", "ts", "_part"]
    assert max(r["count"] for r in rows.groupBy("_part").count().collect()) < 0.4 * 40_000
    placed = temporal.running(rows, ["ts", "id"], {"n": F.lit(1)})
    assert placed.where("n <> id + 1").count() == 0
    assert temporal.shifted(rows, ["ts", "id"], {"before": F.col("id")}).where("coalesce(before, -1) <> id - 1").count() == 0


def test_scans_carry_over_empty_and_null_ranges(spark):
    rng = random.Random(12)
    rows = [(rng.choice("ab"), n, rng.choice([None, None, None, n])) for n in range(400)]
    df = temporal.ranged(spark.createDataFrame(rows, "g string, n long, v long"), ["g", "n"])
    for backward in (False, True):
        got = {(r["g"], r["n"]): r["w"] for r in temporal.filled(df, ["n"], {"w": F.col("v")}, by=["g"], backward=backward).collect()}
        for g, n, _ in rows:
            seen = [v for h, m, v in rows if h == g and v is not None and (m >= n if backward else m <= n)]
            assert got[g, n] == ((min(seen) if backward else max(seen)) if seen else None)


def test_tiles_make_every_range(spark):
    ranges = [(lo, hi) for lo in range(18) for hi in range(lo - 1, 40)]
    df = spark.createDataFrame(ranges, "lo long, hi long")
    levels = tiles.levels_for(df)
    for r in df.withColumn("t", tiles.tiles_of(F.col("lo"), F.col("hi"), levels)).collect():
        covered = [p for t in r["t"] for p in range(t["tile"] * 2 ** t["level"], (t["tile"] + 1) * 2 ** t["level"])]
        assert sorted(covered) == list(range(r["lo"], r["hi"] + 1)) and len(r["t"]) <= 2 * (levels + 1)


def test_windows_of_ten_thousand_bars(spark):
    rng = random.Random(13)
    bars, price = [], 100.0
    for n in range(12_000):
        opened, price = price, price + rng.choice([-1, -0.25, 0, 0.25, 1])
        bars.append((START + timedelta(seconds=n), opened, max(opened, price) + rng.choice([0, 0, 2]), min(opened, price) - rng.choice([0, 0, 2]), price))
    posts = [(f"p{n}", START + timedelta(milliseconds=rng.randrange(12_100_000))) for n in range(60)]
    s = Settings(horizons=(1, 60, 166), whipsaw_minutes=100, whipsaw_first_minutes=10, whipsaw_initial_ticks=40.0)
    moves = post_moves(spark.createDataFrame(posts, "post_id string, received_at_utc timestamp"), spark.createDataFrame(bars, "ts_open_utc timestamp, open double, high double, low double, close double"), s)
    plan = moves._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    flags = {r["post_id"]: r["market_whipsaw_flag"] for r in moves.collect()}
    got = {(r["post_id"], r["horizon"]): r for r in window_targets(moves, s).collect()}
    times, checked = [b[0] for b in bars], 0
    for post, at in posts:
        first = next((n for n, t in enumerate(times) if t >= at), None)
        if first is None:
            assert post not in flags
            continue
        base = bars[first][1]
        for h in s.horizons:
            last = next((n for n, t in enumerate(times) if t >= times[first] + timedelta(minutes=h)), None)
            assert ((post, h) in got) == (last is not None)
            if last is not None:
                inside, r = bars[first : last + 1], got[post, h]
                squares = sum((y[4] - x[4]) ** 2 for x, y in zip(inside, inside[1:], strict=False))
                want = ((inside[-1][4] - base) / 0.25, max((max(b[2] for b in inside) - base) / 0.25, 0), max((base - min(b[3] for b in inside)) / 0.25, 0), round(math.sqrt(squares) / 0.25, 4))
                assert (r["delta_ticks"], r["mfe_ticks"], r["mae_ticks"]) == want[:3] and math.isclose(r["volatility_ticks"], want[3], abs_tol=1e-3)
                checked += 1
        inside = [b for b in bars if times[first] <= b[0] <= times[first] + timedelta(minutes=s.whipsaw_minutes)]
        early = [b for b in inside if b[0] <= times[first] + timedelta(minutes=s.whipsaw_first_minutes)]
        up, down = (max(b[2] for b in early) - base) / 0.25, (base - min(b[3] for b in early)) / 0.25
        if up >= down:
            top = max(range(len(inside)), key=lambda n: (inside[n][2], -n))
            back = (inside[top][2] - min(b[3] for b in inside[top:])) / 0.25
        else:
            top = min(range(len(inside)), key=lambda n: (inside[n][3], n))
            back = (max(b[2] for b in inside[top:]) - inside[top][3]) / 0.25
        assert flags[post] == (max(up, down) >= 40 and back >= max(0.65 * max(up, down), 15))
    assert checked > 80


@pytest.mark.parametrize("few", [4096, 8])
def test_nested_risk_windows(spark, monkeypatch, few):
    monkeypatch.setattr(tiles, "FEW_TILES", few)
    rng = random.Random(14)
    trades = [(f"t{n}", None if n == 5 else START + timedelta(seconds=rng.randrange(20_000))) for n in range(300)]
    risks = [(f"e{n}", START + timedelta(seconds=5 * n), rng.choice(["SOFT_RISK", "HARD_KILL", "SOFT_RISK", "WATCH"]), round(rng.random(), 2), 20_000 - 15 * n if n < 1000 else 60) for n in range(1_200)]
    risks += [("none", None, "HARD_KILL", 9.0, 60)]
    df = spark.createDataFrame(risks, "event_id string, received_at_utc timestamp, whipsaw_risk_level string, whipsaw_score double, risk_ttl_seconds int")
    out = overlay.blockers(spark.createDataFrame(trades, "trade_id string, entry_ts_utc timestamp"), df)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["trade_id"]: (r["blocking_event_id"], r["blocking_risk_level"]) for r in out.collect()}
    for trade, at in trades:
        held = [(level != "HARD_KILL", -score, e, level) for e, since, level, score, ttl in risks if at and since and level != "WATCH" and since + timedelta(seconds=2) <= at <= since + timedelta(seconds=2 + ttl)]
        assert got[trade] == ((min(held)[2], min(held)[3]) if held else (None, None))
