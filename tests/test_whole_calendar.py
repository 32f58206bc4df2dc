"""The queries over the whole calendar against brute force over every error event."""

from datetime import datetime, timedelta

from tideline.plans import registry


def test_whole_calendar(spark, tmp_path):
    start, kinds = datetime(2024, 1, 1), ["error", "signup", "view", "error", "click", "purchase"]
    rows = [(i, start + timedelta(seconds=(i * 7919) % 172_800), i % 9, kinds[i % 6], float(i % 50)) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    errors, want = [(t, i) for i, t, _, kind, _ in rows if kind == "error"], {}
    for i, t, _, kind, _ in rows:
        if kind == "signup":
            at, near = min(errors, key=lambda e: (abs(e[0] - t), e[0], str(e[1])))
            want[str(i)] = (str(near), f"kind_{near % 3}", round((at - t).total_seconds() / 60, 4), -15 <= (at - t).total_seconds() / 60 <= 15)
    got = {r["post_id"]: (r["nearest_macro_event_id"], r["nearest_macro_event_type"], r["minutes_to_nearest_macro_event"], r["is_macro_blackout"]) for r in registry.QUERIES["j5_macro_context"](spark, str(tmp_path)).collect()}
    assert got == want
    from tideline.plans import views

    kept = {r["post_id"] for r in views.event_frame(spark, str(tmp_path))[0].select("post_id").collect()}
    counts = {}
    for i in kept:
        n, b = counts.get(want[i][1], (0, 0))
        counts[want[i][1]] = (n + 1, b + want[i][3])
    assert counts and {r["macro_type"]: (r["n"], r["blackout"]) for r in registry.QUERIES["a14_macro_summary"](spark, str(tmp_path)).collect()} == counts
