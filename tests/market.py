"""A made-up morning of one-minute bars, with posts, a calendar and trades; expected values are worked out by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

OPENING = datetime(2025, 3, 4, 9, 0)
# closes by minute: quiet, a slide, a recovery, a drift, a pause and a rise
CLOSES = (
    [100.0, 100.25, 100.0, 100.25, 100.0, 99.75, 100.0, 100.25, 100.0, 100.0]
    + [99.0, 98.0, 97.0, 96.0, 95.0, 94.0, 93.5, 93.0, 92.5, 92.0]
    + [93.0, 94.0, 95.0, 96.0, 97.0, 98.0, 98.5, 99.0, 99.5, 100.0]
    + [100.25, 100.5, 100.75, 101.0, 101.25, 101.5, 101.75, 102.0, 102.25, 102.5, 102.75, 103.0, 103.25, 103.5, 103.75]
    + [104.0, 103.75, 104.0, 103.75, 104.0, 103.75, 104.0, 103.75, 104.0, 103.75, 104.0, 103.75, 104.0, 103.75, 104.0]
    + [105.0, 106.0, 107.0, 108.0, 109.0, 110.0, 111.0, 112.0, 113.0, 114.0, 115.0, 116.0, 117.0, 118.0, 119.0]
)
# minutes in which a bar reached beyond its open and close: high, low
REACHED = {7: (100.75, 99.5), 19: (92.75, 91.5), 44: (105.0, 103.5)}
POSTS = [
    ("a", "09:05:30", "Steel tariff now"),
    ("b", "09:09:40", "A deal will come, growth!"),
    ("c", "09:25:00", "Oil from Iran"),
    ("d", "09:31:15", "thank you"),
]
LATE = [("e", "09:50:00", "too late for the longest horizon"), ("f", "10:20:00", "after the last bar")]
CALENDAR = [("jobs", "Jobs report", "jobs", "08:30:00", "high"), ("vote", "Vote", "vote", "09:40:00", "medium")]
TRADES = [
    ("t1", "09:10:00", "09:18:00", "long", 2, 100.0, 93.0),
    ("t2", "09:26:00", "09:29:00", "long", 1, 98.0, 99.5),
    ("t3", "09:03:00", "09:04:00", "short", 1, 100.0, 100.25),
]


def at(clock):
    return datetime.combine(OPENING.date(), datetime.strptime(clock, "%H:%M:%S").time())


def bar_rows():
    """(time, open, high, low, close) of each minute."""
    rows = []
    for minute, close in enumerate(CLOSES):
        opened = CLOSES[minute - 1] if minute else 100.0
        high, low = REACHED.get(minute, (max(opened, close), min(opened, close)))
        rows.append((OPENING + timedelta(minutes=minute), opened, high, low, close))
    return rows


def bars(spark):
    rows = [(t, o, h, low, c, 10 * (i + 1), True) for i, (t, o, h, low, c) in enumerate(bar_rows())]
    broken = (OPENING + timedelta(minutes=8, seconds=30), 1.0, 1.0, 1.0, 1.0, 0, False)
    return spark.createDataFrame([*rows, broken], "ts_open_utc timestamp, open double, high double, low double, close double, volume long, is_valid_bar boolean")


def full_bars(spark):
    """The valid bars with all columns of a canonical bar."""
    names = {"symbol_root": "NQ", "contract_symbol": "NQH5", "continuous_symbol": "NQ.c.0", "source_name": "hand", "session_id": "2025-03-04", "is_rth": True, "is_rollover_period": False, "is_holiday_session": False}
    rows = bars(spark).where("is_valid_bar").withColumns({k: F.lit(v) for k, v in names.items()})
    return rows.withColumns({"ts_close_utc": F.expr("ts_open_utc + interval 1 minute"), "trade_count": F.col("volume"), "vwap": F.col("close")})


def posts(spark, rows=POSTS):
    found = [(i, t and at(t), t and at(t) - timedelta(seconds=2), text) for i, t, text in rows]
    return spark.createDataFrame(found, "post_id string, received_at_utc timestamp, created_at_utc timestamp, text_clean string")


def calendar(spark):
    return spark.createDataFrame([(a, b, c, at(t), d) for a, b, c, t, d in CALENDAR], "event_id string, event_name string, event_type string, scheduled_at_utc timestamp, importance string")


def trades(spark):
    return spark.createDataFrame([(a, at(b), at(c), *rest) for a, b, c, *rest in TRADES], "trade_id string, entry_ts_utc timestamp, exit_ts_utc timestamp, side string, contracts int, entry_price double, exit_price double")
