"""Posts aligned with market bars: targets over several horizons, whipsaw flags, macro context, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.time import iso
from .temporal import MINUTE, cut, filled, first_after, forward_asof, keyed, neighbours, ranged, running, shifted, timed
from .tiles import fold, levels_for, over_ranges

SETTINGS = Settings()


def minutes(n: int) -> Column:
    return F.expr(f"make_dt_interval(0, 0, {n}, 0)")


def event_id(post_id: str = "post_id", ts: str = "aligned_bar_ts_utc") -> Column:
    """First 16 hex digits of the SHA-256 of post and bar time."""
    return F.substring(F.sha2(F.concat_ws("|", F.col(post_id), iso(F.col(ts))), 256), 1, 16)


def direction(ticks: Column, flat: float = 4.0) -> Column:
    return F.when(ticks >= flat, "up").when(ticks <= -flat, "down").otherwise("flat")


def tradeability(whipsaw: Column, range_long: Column, delta_middle: Column, delta_long: Column) -> Column:
    return (
        F.when(whipsaw, "no_trade_whipsaw")
        .when((range_long >= 35) & (F.abs(delta_long) < 12), "volatility_only")
        .when(F.abs(delta_middle) >= 8, "tradeable_directional")
        .when(F.abs(delta_long) <= 4, "no_impact")
        .otherwise("ambiguous")
    )


def valid_bars(bars: DataFrame) -> DataFrame:
    return bars.where("is_valid_bar") if "is_valid_bar" in bars.columns else bars


def indexed(bars: DataFrame) -> DataFrame:
    """Valid bars with idx, their position in order of time (then of prices), and step: the change of close from the bar before."""
    order = ["ts_open_utc", "open", "high", "low", "close"]
    rows = ranged(valid_bars(bars).select(*order).where("ts_open_utc is not null"), order)
    rows = running(shifted(rows, order, {"_close": F.col("close")}), order, {"_n": F.lit(1)})
    return cut(rows.select(*order, (F.col("_n") - 1).alias("idx"), (F.col("close") - F.col("_close")).alias("step")))


def align(posts: DataFrame, bars: DataFrame) -> DataFrame:
    """Posts with aligned_bar_ts_utc and base_price of the first valid bar at or after received_at_utc; null where none is."""
    slim = valid_bars(bars).select("ts_open_utc", "open")
    out = forward_asof(posts, slim, "received_at_utc", "ts_open_utc", name="_bar")
    return out.withColumns({"aligned_bar_ts_utc": F.col("_bar.ts_open_utc"), "base_price": F.col("_bar.open")}).drop("_bar")


def _whipsaw_flag(s: Settings) -> Column:
    """A first move of enough ticks, reversed within the window. The larger side of the first minutes decides (up on ties)."""
    up, down = (F.col("first.high") - F.col("open")) / s.tick_size, (F.col("open") - F.col("first.low")) / s.tick_size
    move = F.greatest(up, down)
    reversal = F.when(up >= down, F.col("whole.high") - F.col("after_top.low")).otherwise(F.col("after_bottom.high") - F.col("whole.low")) / s.tick_size
    return (move >= s.whipsaw_initial_ticks) & (reversal >= F.greatest(move * s.whipsaw_reversal_share, F.lit(s.whipsaw_reversal_ticks)))


def bar_moves(bars: DataFrame, starts: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """For each bar of `starts` (of the indexed() bars; each once): its columns, moves and market_whipsaw_flag.

    What follows a post depends on the bar that it is aligned with alone. moves is an array of structs (horizon,
    target_ts, target_close, high, low, squares): the first bar at or after each horizon's end, null where none is,
    and the extremes and the sum of squared steps from the bar to that one. The flag is for the bars within the
    window: its extreme is the first bar with the highest high (lowest low), the reversal counts from that bar on.
    Windows are answered by tiles of bars, as many as the logarithm of their length.
    """
    count = bars.count()
    micros, kinds = F.unix_micros("ts_open_utc"), [*s.horizons, -1, -2]
    # the first minutes (-1) and the whole window (-2) end before the first bar later than their end
    ends = [micros + h * MINUTE for h in s.horizons] + [micros + s.whipsaw_first_minutes * MINUTE + 1, micros + s.whipsaw_minutes * MINUTE + 1]
    asks = starts.select("idx", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), e.alias("end")) for k, e in zip(kinds, ends, strict=True)))).alias("x")).select("idx", "x.*")
    points = bars.select(micros.alias("at"), "idx", "ts_open_utc", "close")
    found = first_after(asks, points, keys=["idx", "kind"], at="end", point_at="at", tie="idx")
    hi = F.when(F.col("kind") > 0, F.col("match.idx")).otherwise(F.coalesce(F.col("match.idx") - 1, F.lit(count - 1)))
    # the first bar has no step in its window, so that it is left out of the tiles
    windows = cut(found.select("idx", "kind", "match", (F.col("idx") + 1).alias("lo"), hi.alias("hi")))
    levels = levels_for(windows)
    tiles = cut(fold(bars, "idx", levels, {"high": F.max("high"), "low": F.min("low"), "top": F.min(F.struct(-F.col("high"), "idx")), "bottom": F.min(F.struct("low", "idx")), "squares": F.sum(F.col("step") * F.col("step"))}))
    extremes = {"high": F.max("high"), "low": F.min("low"), "top": F.min("top"), "bottom": F.min("bottom"), "squares": F.sum("squares")}
    within = over_ranges(windows.where("hi is not null"), ["idx", "kind"], tiles, levels, extremes)
    top, bottom = F.least(F.struct(-F.col("b.high"), F.col("b.idx")), F.col("w.top")), F.least(F.struct(F.col("b.low"), F.col("b.idx")), F.col("w.bottom"))
    first = starts.alias("b").join(windows.alias("q"), F.col("b.idx") == F.col("q.idx")).join(within.alias("w"), (F.col("q.idx") == F.col("w.idx")) & (F.col("q.kind") == F.col("w.kind")), "left")
    first = cut(first.select("b.idx", "q.kind", "q.match", "q.hi", F.greatest("b.high", "w.high").alias("high"), F.least("b.low", "w.low").alias("low"), top["idx"].alias("top"), bottom["idx"].alias("bottom"), F.coalesce("w.squares", F.lit(0.0)).alias("squares")))
    whole = first.where("kind = -2")
    turns = whole.select("idx", F.explode(F.array(F.struct(F.lit("top").alias("from"), F.col("top").alias("lo")), F.struct(F.lit("bottom").alias("from"), F.col("bottom").alias("lo")))).alias("x"), "hi").select("idx", "x.*", "hi")
    after = over_ranges(turns, ["idx", "from"], tiles, levels, {"high": F.max("high"), "low": F.min("low")})
    pick = lambda when: F.max(F.when(when, F.struct("high", "low")))
    after = after.groupBy("idx").agg(pick(F.col("from") == "top").alias("after_top"), pick(F.col("from") == "bottom").alias("after_bottom"))
    horizon = F.col("kind") > 0
    move = F.struct(F.col("kind").alias("horizon"), F.col("match.ts_open_utc").alias("target_ts"), F.col("match.close").alias("target_close"), "high", "low", "squares")
    moves = first.groupBy("idx").agg(F.array_sort(F.collect_list(F.when(horizon, move))).alias("moves"), pick(F.col("kind") == -1).alias("first"), pick(F.col("kind") == -2).alias("whole"))
    out = starts.join(moves, "idx").join(after, "idx").withColumn("market_whipsaw_flag", _whipsaw_flag(s))
    return out.drop("first", "whole", "after_top", "after_bottom")


def post_moves(posts: DataFrame, bars: DataFrame, s: Settings = SETTINGS, *, key: str = "post_id") -> DataFrame:
    """key (it tells posts apart), aligned_bar_ts_utc, base_price, moves and market_whipsaw_flag (as bar_moves() has them) of posts with a bar after them.

    Posts find their bar by a scan, and then what follows that bar by a second one over the bars in use: no task gets
    all posts of one bar.
    """
    bars = indexed(bars)
    slim = timed(posts.select(key, "received_at_utc"), "received_at_utc")[0].withColumn("_at", F.unix_micros("received_at_utc"))
    points = bars.withColumn("_at", F.unix_micros("ts_open_utc"))
    starts = cut(first_after(slim, points, keys=[key], at="_at", point_at="_at", tie="idx").where("match is not null").select("match.*").drop("_at").distinct())
    ready = bar_moves(bars, starts, s).withColumn("_at", F.unix_micros("ts_open_utc"))
    out = first_after(slim, ready, keys=[key], at="_at", point_at="_at").where("match is not null")
    return out.select(key, F.col("match.ts_open_utc").alias("aligned_bar_ts_utc"), F.col("match.open").alias("base_price"), "match.moves", "match.market_whipsaw_flag")


def horizon_targets(moves: DataFrame, s: Settings = SETTINGS, *, key: str = "post_id") -> DataFrame:
    """One row per post and horizon (minutes) of post_moves(): target_ts, target_close and the move in ticks; null where no bar is at or after the horizon's end."""
    long = moves.select(key, "aligned_bar_ts_utc", "base_price", F.explode("moves").alias("_m")).select(key, "aligned_bar_ts_utc", "base_price", "_m.*")
    return long.withColumn("delta_ticks", F.round((F.col("target_close") - F.col("base_price")) / s.tick_size, 4))


def window_targets(moves: DataFrame, s: Settings = SETTINGS, *, key: str = "post_id") -> DataFrame:
    """Delta, direction, excursions, range and volatility in ticks per post and horizon that has a target."""
    tick, base = F.lit(s.tick_size), F.col("base_price")
    return horizon_targets(moves, s, key=key).where("target_ts is not null").select(
        key, "horizon", "aligned_bar_ts_utc", "base_price", "target_ts", "delta_ticks",
        direction(F.col("delta_ticks"), s.flat_ticks).alias("direction"),
        F.round(F.greatest((F.col("high") - base) / tick, F.lit(0.0)), 4).alias("mfe_ticks"),
        F.round(F.greatest((base - F.col("low")) / tick, F.lit(0.0)), 4).alias("mae_ticks"),
        F.round((F.col("high") - F.col("low")) / tick, 4).alias("range_ticks"),
        F.round(F.sqrt("squares") / tick, 4).alias("volatility_ticks"),
    )


def macro_context(posts: DataFrame, calendar: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Adds the nearest calendar event on either side (the earlier on ties), signed minutes to it, and the blackout flag.

    Nearest is the closer of the next event at or after the post and the last at or before it: one scan each way.
    """
    slim = calendar.groupBy("scheduled_at_utc").agg(F.min_by(F.struct("event_id", "event_type", "importance"), "event_id").alias("what"))
    slim = slim.select("scheduled_at_utc", F.col("what.event_id").alias("macro_id"), F.col("what.event_type").alias("macro_type"), F.col("what.importance").alias("macro_importance"))
    posts = keyed(posts, "_macro")
    at = F.unix_micros("received_at_utc")
    asks, events = posts.select("_macro", at.alias("_at"), (-at).alias("_back")), slim.withColumns({"_at": F.unix_micros("scheduled_at_utc"), "_back": -F.unix_micros("scheduled_at_utc")})
    after = first_after(asks, events, keys=["_macro"], at="_at", point_at="_at", name="_after")
    before = first_after(asks, events, keys=["_macro"], at="_back", point_at="_back", name="_before")
    back = posts.join(after, "_macro", "left").join(before, "_macro", "left")
    gap = lambda c: F.unix_micros(c) - F.unix_micros("received_at_utc")
    a, b = gap("_after.scheduled_at_utc"), gap("_before.scheduled_at_utc")
    near = F.when(b.isNull() | (F.abs(a) < F.abs(b)), F.struct("_after.macro_id", "_after.macro_type", "_after.macro_importance", a.alias("gap")))
    near = near.otherwise(F.struct("_before.macro_id", "_before.macro_type", "_before.macro_importance", b.alias("gap")))
    m = F.col("_near.gap") / MINUTE
    return back.withColumn("_near", near).withColumns(
        {
            "nearest_macro_event_id": F.col("_near.macro_id"),
            "nearest_macro_event_type": F.col("_near.macro_type"),
            "nearest_macro_event_importance": F.col("_near.macro_importance"),
            "minutes_to_nearest_macro_event": F.round(m, 4),
            "is_macro_blackout": F.coalesce((m >= -s.blackout_after) & (m <= s.blackout_before), F.lit(False)),
        }
    ).drop("_near", "_after", "_before", "_macro")


def clusters(events: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Gaps, overlap flags and clusters of events whose gap is at most the longest horizon.

    A cluster's number, first event and size come from scans over times and ids, one each way: the first event is
    carried forward, and the place of the next cluster's first event back. Events without a time are in no cluster.
    """
    gap, order, events = max(s.horizons) * MINUTE, ["received_at_utc", "post_id", "event_id", "_place"], keyed(events, "_place")
    rows = neighbours(ranged(timed(events.select(*order), "received_at_utc")[0], order), order, "received_at_utc")
    since, until = F.unix_micros("received_at_utc") - F.unix_micros("previous_ts"), F.unix_micros("next_ts") - F.unix_micros("received_at_utc")
    near = rows.withColumns(
        {
            "minutes_since_previous_event": F.round(since / MINUTE, 4),
            "minutes_until_next_event": F.round(until / MINUTE, 4),
            "overlaps_prior_event_window": F.coalesce(since <= gap, F.lit(False)),
            "overlaps_next_event_window": F.coalesce(until <= gap, F.lit(False)),
        }
    )
    begins = ~F.col("overlaps_prior_event_window")
    numbered = cut(running(near, order, {"event_cluster_number": F.when(begins, 1).otherwise(0), "_index": F.lit(1)}))
    begun = filled(numbered, order, {"_first": F.when(begins, F.struct("event_id", "received_at_utc", "_index"))})
    ended = filled(begun, order, {"_last": F.when(~F.col("overlaps_next_event_window"), F.col("_index"))}, backward=True)
    name = F.concat_ws("|", F.lit("cluster"), F.col("_first.event_id"), iso(F.col("_first.received_at_utc")), F.lit(str(max(s.horizons))))
    size = F.col("_last") - F.col("_first._index") + 1
    out = ended.select(
        "_place", "minutes_since_previous_event", "minutes_until_next_event", "overlaps_prior_event_window", "overlaps_next_event_window", "event_cluster_number",
        size.alias("event_cluster_size"), (F.col("_index") - F.col("_first._index")).alias("event_cluster_position"), F.substring(F.sha2(name, 256), 1, 16).alias("event_cluster_id"),
        (size == 1).alias("is_isolated_event"), (size > 1).alias("is_burst_event"),
    )
    return events.join(out, "_place", "left").drop("_place")


def build_events(posts: DataFrame, bars: DataFrame, calendar: DataFrame | None = None, s: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """Events with all targets, and (post_id, reason) of posts left out.

    Every row of posts is a post: ids may be repeated (edited posts) or null. A post without a time, without a bar
    after it, or without a bar at or after each horizon's end, gives no event.
    """
    posts = keyed(posts)
    moves = cut(post_moves(posts, bars, s, key="_row"))
    names = {"delta_ticks": "nq_delta_{}m_ticks", "direction": "nq_direction_{}m", "mfe_ticks": "max_favourable_excursion_{}m_ticks", "mae_ticks": "max_adverse_excursion_{}m_ticks", "range_ticks": "realised_range_{}m_ticks", "volatility_ticks": "realised_volatility_{}m_ticks"}
    long = window_targets(moves, s, key="_row")
    wide = long.groupBy("_row").agg(F.count("*").alias("_n"), *(F.max(F.when(F.col("horizon") == h, F.col(k))).alias(v.format(h)) for h in s.horizons for k, v in names.items()))
    whole = wide.where(F.col("_n") == len(s.horizons)).drop("_n").join(moves.drop("moves"), "_row")
    middle, last = s.horizons[len(s.horizons) // 2], s.horizons[-1]
    label = tradeability(F.col("market_whipsaw_flag"), F.col(f"realised_range_{last}m_ticks"), F.col(f"nq_delta_{middle}m_ticks"), F.col(f"nq_delta_{last}m_ticks"))
    events = cut(posts.join(whole, "_row").withColumn("event_id", event_id()).withColumn("tradeability_label", label))
    reason = F.when(F.col("received_at_utc").isNull(), "no_received_at").when(F.col("aligned_bar_ts_utc").isNull(), "no_market_bar_after_received_at").otherwise("insufficient_forward_bars")
    skipped = posts.join(moves.select("_row", "aligned_bar_ts_utc"), "_row", "left").join(events.select("_row"), "_row", "left_anti").select("post_id", reason.alias("reason"))
    if calendar is not None:
        events = macro_context(events, calendar, s)
    return clusters(events, s).drop("_row"), skipped
