"""Trades replayed through risk windows, account rules, and what the overlay cost or saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.time import utc_day
from .temporal import cut, first_after, keyed, ranged, running, running_max, timed
from .tiles import covering, levels_for, tiles_of

SETTINGS = Settings()


def pnl(contracts: Column, s: Settings = SETTINGS, *, costs: bool) -> Column:
    """Profit of a trade's columns side, entry_price and exit_price; no contracts give 0, an unknown side is an error."""
    move = F.col("exit_price") - F.col("entry_price")
    side = F.lower(F.col("side"))
    signed = F.when(side == "long", move).when(side == "short", -move).otherwise(F.raise_error(F.concat(F.lit("unsupported side: "), F.coalesce("side", F.lit("null")))).cast("double"))
    gross = signed / s.tick_size * s.tick_value * contracts
    fee = (2 * s.commission + 2 * s.slippage_ticks * s.tick_value) * contracts
    return F.when(contracts <= 0, 0.0).otherwise(F.round(gross - fee if costs else gross, 4))


def blockers(trades: DataFrame, scored: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Trades with the risk event that blocks them: hard before soft, then the higher score, then the smaller event id.

    An event is in force from its receipt plus the latency for its time to live, both ends included. Trades are
    placed in order of entry; an event covers a range of places, which is made of few tiles, and a tile keeps the best
    of the events that cover it. A trade looks at the tiles that it is in: trades and events never meet.
    """
    trades = keyed(trades, "_trade")
    order = ["entry_ts_utc", "_trade"]
    placed = running(ranged(timed(trades.select(*order), "entry_ts_utc")[0], order), order, {"_n": F.lit(1)})
    placed = cut(placed.select("_trade", (F.col("_n") - 1).alias("place"), F.unix_micros("entry_ts_utc").alias("at")))
    count = placed.count()
    risky = scored.where(F.col("whipsaw_risk_level").isin("SOFT_RISK", "HARD_KILL")).where("received_at_utc is not null and risk_ttl_seconds is not null")
    start = F.unix_micros("received_at_utc") + s.latency_seconds * 1_000_000
    rank = F.struct(F.when(F.col("whipsaw_risk_level") == "HARD_KILL", 0).otherwise(1).alias("order"), (-F.col("whipsaw_score")).alias("score"), "event_id", "whipsaw_risk_level")
    spans = risky.select(rank.alias("rank"), start.alias("start"), (start + F.col("risk_ttl_seconds").cast("long") * 1_000_000 + 1).alias("stop"))
    # of events in force for the same time only the best counts
    spans = keyed(spans.groupBy("start", "stop").agg(F.min("rank").alias("rank")), "_span")
    asks = spans.select("_span", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("start").alias("when")), F.struct(F.lit(1).alias("end"), F.col("stop").alias("when")))).alias("x")).select("_span", "x.*")
    found = first_after(asks, placed.select("at", "place"), keys=["_span", "end"], at="when", point_at="at", tie="place")
    here = F.coalesce("match.place", F.lit(count))
    ends = found.groupBy("_span").agg(F.max(F.when(F.col("end") == 0, here)).alias("lo"), (F.max(F.when(F.col("end") == 1, here)) - 1).alias("hi"))
    ranges = cut(spans.select("_span", "rank").join(ends, "_span"))
    levels = levels_for(ranges)
    tiles = ranges.select("rank", F.explode(tiles_of(F.col("lo"), F.col("hi"), levels)).alias("t")).groupBy("t.level", "t.tile").agg(F.min("rank").alias("rank"))
    best = covering(placed, "place", ["_trade"], count, cut(tiles), levels, {"rank": F.min("rank")})
    best = best.select("_trade", F.col("rank.event_id").alias("blocking_event_id"), F.col("rank.whipsaw_risk_level").alias("blocking_risk_level"))
    return trades.join(best, "_trade", "left").drop("_trade")


def replay(trades: DataFrame, scored: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Trades with profit before, the decision, contracts left and profit after."""
    out = blockers(trades, scored, s)
    hard, soft = F.col("blocking_risk_level") == "HARD_KILL", F.col("blocking_risk_level") == "SOFT_RISK"
    reduce_ = F.lit(s.soft_action == "REDUCE_SIZE")
    half = F.floor(F.col("contracts") * 0.5).cast("int")
    after = F.when(hard, 0).when(soft, F.when(reduce_, half).otherwise(0)).otherwise(F.col("contracts"))
    out = out.withColumns(
        {
            "contracts_after": after.cast("int"),
            "kill_switch_status": F.when(hard, "filtered").when(soft, F.when(reduce_ & (half > 0), "reduced").otherwise("filtered")).otherwise("unchanged"),
            "risk_multiplier": F.when(hard, 0.0).when(soft, F.when(reduce_, 0.5).otherwise(0.0)).otherwise(1.0),
            "gross_pnl_before_usd": pnl(F.col("contracts"), s, costs=False),
            "net_pnl_before_usd": pnl(F.col("contracts"), s, costs=True),
        }
    )
    out = out.withColumn("net_pnl_after_usd", pnl(F.col("contracts_after"), s, costs=True))
    out = out.withColumn("kill_switch_value_usd", F.round(F.col("net_pnl_after_usd") - F.col("net_pnl_before_usd"), 4))
    value, status = F.col("kill_switch_value_usd"), F.col("kill_switch_status")
    label = F.when(status.isin("filtered", "reduced") & (value > 0), "helpful_risk_reduction").when(status.isin("filtered", "reduced") & (value < 0), "false_positive_cost").when((status == "unchanged") & (F.col("net_pnl_before_usd") < 0), "false_negative_loss").otherwise("neutral_or_unaffected")
    return out.withColumn("attribution_label", label)


def report(trades: DataFrame) -> DataFrame:
    """One row of totals, with the overlay's false-positive cost and false-negative loss."""
    status, before, after, value = F.col("kill_switch_status"), F.col("net_pnl_before_usd"), F.col("net_pnl_after_usd"), F.col("kill_switch_value_usd")
    total = lambda when, x: F.round(F.coalesce(F.sum(F.when(when, x)), F.lit(0.0)), 4)
    filtered = status == "filtered"
    return trades.agg(
        F.count("*").alias("trade_count"),
        F.count_if(filtered).alias("filtered_trades"),
        F.count_if(status == "reduced").alias("reduced_trades"),
        F.count_if(status == "unchanged").alias("unchanged_trades"),
        F.round(F.sum(before), 4).alias("net_pnl_before_usd"),
        F.round(F.sum(after), 4).alias("net_pnl_after_usd"),
        F.round(F.sum(after) - F.sum(before), 4).alias("kill_switch_value_usd"),
        total(filtered & (before < 0), -before).alias("avoided_losing_trade_usd"),
        total(filtered & (before > 0), before).alias("missed_winning_trade_usd"),
        total(value < 0, -value).alias("false_positive_cost_usd"),
        total((status == "unchanged") & (before < 0), -before).alias("false_negative_loss_usd"),
    )


def equity(trades: DataFrame, pnl_column: str, s: Settings = SETTINGS) -> DataFrame:
    """Trades with cumulative profit, equity and its running high, by exit time and trade id; trades without an exit have none."""
    trades = keyed(trades, "_trade")
    order = ["exit_ts_utc", "trade_id", "_trade"]
    rows = running(ranged(timed(trades.select(*order, pnl_column), "exit_ts_utc")[0], order), order, {"cumulative_pnl": F.col(pnl_column)})
    rows = cut(rows.withColumn("equity", F.lit(s.starting_balance) + F.col("cumulative_pnl")))
    return trades.join(running_max(rows, order, "equity", "running_high").select("_trade", "cumulative_pnl", "equity", "running_high"), "_trade", "left").drop("_trade")


def breaches(trades: DataFrame, pnl_column: str, s: Settings = SETTINGS) -> DataFrame:
    """One row: days (UTC, of the exit) at or under the daily limit, trades at or under the total limit, trades at or over the drawdown."""
    trades = keyed(trades.select("trade_id", "exit_ts_utc", pnl_column), "_trade")
    line = equity(trades, pnl_column, s)
    days = trades.groupBy(utc_day(F.col("exit_ts_utc")).alias("day")).agg(F.round(F.sum(pnl_column), 6).alias("p")).agg(F.count_if(F.col("p") <= -s.daily_loss).alias("daily_loss_breaches"))
    cumulative, high = F.round("cumulative_pnl", 6), F.round(F.col("running_high") - F.col("equity"), 6)
    rest = line.agg(F.count_if(cumulative <= -s.maximum_loss).alias("maximum_loss_breaches"), F.count_if(high >= s.trailing_drawdown).alias("trailing_drawdown_breaches"))
    return days.crossJoin(rest)
