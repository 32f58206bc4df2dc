"""Bars, calendars, trades and reviewed labels from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import utc_day
from ..operators.labels import REQUIRED, check_reviews
from ..operators.quality import audit_bars, bar_mask, keep_latest, require_columns, to_bool, utc_timestamp

NANO = 1_000_000_000.0
# Columns of a canonical bar.
BAR_COLUMNS = ["symbol_root", "contract_symbol", "continuous_symbol", "ts_open_utc", "ts_close_utc", "open", "high", "low", "close", "volume", "trade_count", "vwap", "source_name", "is_rth", "session_id", "is_rollover_period", "is_holiday_session", "is_valid_bar"]
FLAGS = ["is_rth", "is_rollover_period", "is_holiday_session", "is_valid_bar"]
# Names that vendors give the same column.
TIME_NAMES = ["ts_open_utc", "ts_event", "timestamp", "datetime", "time"]
PRICE_NAMES = {"open": ["open"], "high": ["high"], "low": ["low"], "close": ["close"], "volume": ["volume"]}


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").lower().endswith(".parquet") else spark.read.option("header", True).csv(path)


def canonical_bars(df: DataFrame) -> DataFrame:
    """A table with all bar columns, typed, one row per (open time, contract) with the last kept, in order."""
    require_columns(df, BAR_COLUMNS, "bars")
    order = F.monotonically_increasing_id()
    out = df.select(
        *(F.col(c).cast("string").alias(c) for c in ("symbol_root", "contract_symbol", "continuous_symbol", "source_name", "session_id")), *(utc_timestamp(F.col(c).cast("string")).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("timestamp").alias(c) for c in ("ts_open_utc", "ts_close_utc")),
        *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "vwap")), F.col("volume").cast("double").cast("long").alias("volume"), F.coalesce(F.col("trade_count").cast("double").cast("long"), F.lit(0)).alias("trade_count"), *(to_bool(F.col(c)).alias(c) for c in FLAGS), order.alias("_at"),
    )
    return keep_latest(out, ["ts_open_utc", "contract_symbol"], [F.col("_at")]).select(*BAR_COLUMNS).orderBy("ts_open_utc", "contract_symbol")


def load_bars(spark: SparkSession, path: str) -> DataFrame:
    return canonical_bars(read_text_table(spark, path))


def scaled(c: Column) -> Column:
    """Prices above 1e9 are in units of 1e-9, value by value."""
    p = c.cast("double")
    return F.when(F.abs(p) > NANO, p / NANO).otherwise(p)


def contract_symbol(df: DataFrame, requested: str | None, root: str) -> Column:
    """The caller's value, else the only symbol of the table, else the root."""
    if requested:
        return F.lit(requested)
    if "symbol" not in df.columns:
        return F.lit(root)
    one = df.agg(F.count_distinct("symbol").alias("n"), F.min(F.col("symbol").cast("string")).alias("s")).first()
    return F.lit(one["s"] if one["n"] == 1 else root)


def normalise_bars(df: DataFrame, *, source_name: str = "vendor", symbol_root: str = "NQ", contract: str | None = None, continuous: str | None = None) -> DataFrame:
    """Vendor bars of one minute: any of the known names in any case, scaled prices, defaults, validity; canonical tables pass."""
    if all(c in df.columns for c in BAR_COLUMNS):
        return canonical_bars(df)
    lower = {c.lower(): c for c in df.columns}
    names = {canonical: lower[a] for canonical, aliases in PRICE_NAMES.items() if canonical not in df.columns for a in aliases if a in lower}
    df = df.withColumnsRenamed({v: k for k, v in names.items()})
    time = next((lower[n] for n in TIME_NAMES if n in lower), None)
    if time is None:
        raise ValueError(f"bars lack a time column: {TIME_NAMES}")
    require_columns(df, ["open", "high", "low", "close"], "bars")
    symbol = contract_symbol(df, contract, symbol_root)
    ts = F.col(time).cast("timestamp") if dict(df.dtypes)[time] != "string" else utc_timestamp(F.col(time))
    whole = lambda *cs: F.coalesce(*(F.col(c).try_cast("double").cast("long") for c in cs if c in df.columns), F.lit(0))
    flag = lambda c: to_bool(F.col(c)) if c in df.columns else F.lit(False)
    prices = {c: scaled(F.col(c)) for c in ("open", "high", "low", "close")}
    mean = (prices["open"] + prices["high"] + prices["low"] + prices["close"]) / 4.0
    out = df.select(
        F.lit(symbol_root).alias("symbol_root"), symbol.alias("contract_symbol"), (F.lit(continuous) if continuous else symbol).alias("continuous_symbol"), ts.alias("ts_open_utc"), F.timestamp_micros(F.unix_micros(ts) + 60_000_000).alias("ts_close_utc"),
        *(c.alias(k) for k, c in prices.items()), whole("volume").alias("volume"), whole("trade_count", "count").alias("trade_count"), (scaled(F.col("vwap")) if "vwap" in df.columns else mean).alias("vwap"), F.lit(source_name).alias("source_name"),
        flag("is_rth").alias("is_rth"), utc_day(ts).cast("string").alias("session_id"), flag("is_rollover_period").alias("is_rollover_period"), flag("is_holiday_session").alias("is_holiday_session"), F.monotonically_increasing_id().alias("_at"),
    )
    out = out.withColumn("is_valid_bar", F.coalesce(bar_mask(), F.lit(False)))
    return keep_latest(out, ["ts_open_utc", "contract_symbol"], [F.col("_at")]).select(*BAR_COLUMNS).orderBy("ts_open_utc", "contract_symbol")


def load_vendor_bars(spark: SparkSession, path: str, **names) -> DataFrame:
    return normalise_bars(read_text_table(spark, path), **names)


def vendor_audit(raw: DataFrame, bars: DataFrame, request: dict[str, str]) -> DataFrame:
    """One row: what was asked of the vendor (a map), raw rows, and audit_bars() of what became of them."""
    asked = F.create_map(*(F.lit(x) for kv in request.items() for x in kv)) if request else F.create_map().cast("map<string,string>")
    counts = raw.agg(F.count("*").alias("raw_row_count")).withColumn("_one", F.lit(1))
    audit = audit_bars(bars).withColumn("_one", F.lit(1))
    return counts.join(audit, "_one").drop("_one").withColumn("request", asked)


def load_calendar(spark: SparkSession, path: str) -> DataFrame:
    rows = require_columns(spark.read.option("header", True).csv(path), ["event_id", "event_name", "event_type", "scheduled_at_utc", "importance"], "calendar")
    return rows.withColumn("scheduled_at_utc", utc_timestamp(F.col("scheduled_at_utc"))).orderBy("scheduled_at_utc")


def load_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades in order of entry; contracts must be positive."""
    rows = require_columns(spark.read.option("header", True).csv(path), ["trade_id", "entry_ts_utc", "exit_ts_utc", "side", "contracts", "entry_price", "exit_price"], "trades")
    count = F.col("contracts").cast("int")
    checked = F.when(count > 0, count).otherwise(F.raise_error(F.lit("contracts must be positive")).cast("int"))
    return rows.select("trade_id", utc_timestamp(F.col("entry_ts_utc")).alias("entry_ts_utc"), utc_timestamp(F.col("exit_ts_utc")).alias("exit_ts_utc"), "side", checked.alias("contracts"), F.col("entry_price").cast("double").alias("entry_price"), F.col("exit_price").cast("double").alias("exit_price")).orderBy("entry_ts_utc")


def load_reviews(spark: SparkSession, path: str, *, label_version: str) -> DataFrame:
    """Reviewed labels with their problems; see check_reviews()."""
    rows = require_columns(spark.read.option("header", True).csv(path), REQUIRED, "reviews")
    return check_reviews(rows, label_version)
