"""Validity checks, quarantine, deduplication and audits of posts, bars and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import POST_TYPES
from ..functions.time import utc_text
from .temporal import cut

OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    return sorted(set(names) - set(df.columns))


def to_bool(c: Column) -> Column:
    """true, 1, yes and false, 0, no in any case; anything else is an error."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(low, F.lit("null")))).cast("boolean"))


def post_type(c: Column) -> Column:
    """Blank to unknown, known types as they are in lower case, others to original."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(c.isNull() | (c.cast("string") == ""), "unknown").when(low.isin(*POST_TYPES), low).otherwise("original")


def utc_timestamp(c: Column) -> Column:
    """ISO text with an offset to a timestamp; null without an offset or where it can't be read."""
    return F.when(c.rlike(OFFSET), F.try_to_timestamp(c))


def any_timestamp(c: Column) -> Column:
    """ISO text with an offset, or epoch seconds, or (above 1e10) milliseconds."""
    text = c.cast("string")
    number = F.try_to_number(F.when(text.rlike(r"^\d{1,18}$"), text), F.lit("9" * 18)).cast("double")
    number = F.coalesce(number, text.try_cast("double"))
    return F.coalesce(utc_timestamp(text), F.timestamp_micros((F.when(number > 1e10, number / 1000).otherwise(number) * 1e6).cast("long")))


def coercion_failures(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and failures: values that are there but that any_timestamp() can't read, for each of the columns in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNotNull() & any_timestamp(F.col(c)).isNull()).alias(c) for c in columns))
    return counts.unpivot([], columns, "column", "failures")


def rss_timestamp(c: Column) -> Column:
    """RFC 822 dates (the weekday is dropped) or ISO text with an offset."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(bare, r"(GMT|UTC)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")), utc_timestamp(F.trim(c)))


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order, aggregated before rows move."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def bar_mask() -> Column:
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    whole = prices[0].isNotNull()
    for p in prices[1:]:
        whole = whole & p.isNotNull()
    return whole & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("volume") >= 0)


def bar_problems(df: DataFrame, symbols: tuple[str, ...] = ("NQ", "MNQ")) -> DataFrame:
    """Adds `problems`: an array of what is wrong with a bar, empty for good ones."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    checks = {
        "unknown symbol": ~F.coalesce(F.col("symbol_root").isin(*symbols), F.lit(False)),
        "blank identifier": blank("contract_symbol") | blank("continuous_symbol") | blank("source_name") | blank("session_id"),
        "closes before it opens": ~F.coalesce(F.col("ts_close_utc") > F.col("ts_open_utc"), F.lit(False)),
        "prices out of order": F.col("is_valid_bar") & ~F.coalesce(bar_mask(), F.lit(False)),
    }
    return df.withColumn("problems", F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items()))))


def post_problems(df: DataFrame) -> DataFrame:
    """Adds `problems` of posts: missing times, receipt before creation, unknown type."""
    checks = {
        "no creation time": F.col("created_at_utc").isNull(),
        "no receipt time": F.col("received_at_utc").isNull(),
        "received before created": F.col("received_at_utc") < F.col("created_at_utc"),
        "unknown type": ~F.coalesce(F.col("post_type").isin(*POST_TYPES), F.lit(False)),
    }
    return df.withColumn("problems", F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items()))))


def split_quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the column, and rows that have problems."""
    return checked.where(F.size("problems") == 0).drop("problems"), checked.where(F.size("problems") > 0)


def audit_posts(posts: DataFrame) -> DataFrame:
    """One row: rows, duplicate ids and hashes, empty and media-only texts, first and last creation, longest lag."""
    empty = F.trim(F.coalesce("text_clean", F.lit(""))) == ""
    return posts.agg(
        F.count("*").alias("row_count"),
        (F.count("post_id") - F.count_distinct("post_id")).alias("duplicate_post_ids"),
        (F.count("content_hash") - F.count_distinct("content_hash")).alias("duplicate_content_hashes"),
        F.count_if(empty).alias("empty_text_rows"),
        F.count_if(empty & (F.col("has_image") | F.col("has_video"))).alias("media_only_rows"),
        utc_text(F.min("created_at_utc")).alias("min_created_at"),
        utc_text(F.max("created_at_utc")).alias("max_created_at"),
        F.max(F.unix_millis("received_at_utc") - F.unix_millis("created_at_utc")).alias("max_feed_lag_ms"),
    )


def audit_sources(posts: DataFrame) -> DataFrame:
    """audit_posts() for each source_name and source_provider."""
    empty = F.trim(F.coalesce("text_clean", F.lit(""))) == ""
    return posts.groupBy("source_name", "source_provider").agg(
        F.count("*").alias("row_count"),
        (F.count("post_id") - F.count_distinct("post_id")).alias("duplicate_post_ids"),
        F.count_if(empty).alias("empty_text_rows"),
        F.count_if(empty & (F.col("has_image") | F.col("has_video"))).alias("media_only_rows"),
        F.max(F.unix_millis("received_at_utc") - F.unix_millis("created_at_utc")).alias("max_feed_lag_ms"),
    )


def freshness(posts: DataFrame, checked_at: str, stale_minutes: int = 30, required: list[str] | None = None) -> DataFrame:
    """audit_posts() with lag at a moment (a timestamp literal), the stale flag, and columns that are missing."""
    lag = F.unix_timestamp(F.lit(checked_at).cast("timestamp")) - F.unix_timestamp(F.max("created_at_utc"))
    late = posts.agg(lag.alias("max_post_lag_seconds"), F.count_if(F.col("created_at_utc").isNull()).alias("invalid_timestamp_rows"))
    late = late.withColumns({"is_stale": F.col("max_post_lag_seconds") > stale_minutes * 60, "missing_columns": F.lit(",".join(missing_columns(posts, required or [])))})
    return audit_posts(posts).crossJoin(late)


def bar_gaps(bars: DataFrame, minutes: int = 1) -> DataFrame:
    """Valid bars, one per (open time, contract), with gap and stale flags within contract and session."""
    one = keep_latest(bars.where("is_valid_bar"), ["ts_open_utc", "contract_symbol"], [F.col("ts_close_utc"), F.col("volume")])
    w = Window.partitionBy("contract_symbol", "session_id").orderBy("ts_open_utc")
    same = F.lit(True)
    for c in ("open", "high", "low", "close"):
        same = same & (F.col(c) == F.lag(c).over(w))
    gap = (F.unix_timestamp("ts_open_utc") - F.unix_timestamp(F.lag("ts_open_utc").over(w))) > minutes * 60
    return one.withColumns({"is_gap": F.coalesce(gap, F.lit(False)), "is_stale": F.coalesce(same & (F.col("volume") == 0) & (F.col("trade_count") == 0), F.lit(False))})


def coverage(bars: DataFrame, minutes: int = 1) -> DataFrame:
    """Expected, missing, gap and stale bars per contract and session."""
    span = F.floor((F.unix_timestamp(F.max("ts_open_utc")) - F.unix_timestamp(F.min("ts_open_utc"))) / (60 * minutes)) + 1
    per = bar_gaps(bars, minutes).groupBy("contract_symbol", "session_id").agg(span.alias("expected_bars"), F.count("*").alias("n"), F.count_if("is_gap").alias("gaps"), F.count_if("is_stale").alias("stale_bars"))
    return per.select("contract_symbol", "session_id", "expected_bars", (F.col("expected_bars") - F.col("n")).alias("missing_bars"), "gaps", "stale_bars")


def audit_bars(bars: DataFrame, minutes: int = 1) -> DataFrame:
    """One row: counts of rows, validity, duplicates, bad prices, zero volume, coverage; names sorted."""
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("volume") < 0)
    names = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    first = bars.agg(
        F.count("*").alias("row_count"), F.count_if("is_valid_bar").alias("valid_rows"), F.count_if(~F.col("is_valid_bar")).alias("invalid_rows"),
        utc_text(F.min(F.when(F.col("is_valid_bar"), F.col("ts_open_utc")))).alias("min_ts"), utc_text(F.max(F.when(F.col("is_valid_bar"), F.col("ts_open_utc")))).alias("max_ts"),
        F.count_if(bad).alias("invalid_ohlc_rows"), F.count_if(F.col("volume") == 0).alias("zero_volume_rows"),
        names("symbol_root").alias("symbols"), names("contract_symbol").alias("contracts"), names("source_name").alias("sources"),
        (F.count("*") - F.count_distinct("ts_open_utc", "contract_symbol")).alias("duplicate_bar_keys"),
    )
    cover = coverage(bars, minutes).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected_bars", "missing_bars", "gaps", "stale_bars")))
    return first.crossJoin(cover)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that doesn't depend on the order of rows: count and a sum of row hashes over columns in name order."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values in the given order, each with its length before it and null apart from all texts. Pass texts, whole numbers and truth values: other types have no one text."""
    parts = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def digest_tree(df: DataFrame, key: str, *, span: int = 64, fan: int = 16, levels: int = 6) -> DataFrame:
    """Columns level, node, row_count and digest: a tree of digests over ranges of a whole-number key, so that a changed row names its range.

    A node of level 0 covers `span` keys, one of level k covers `fan` times as many as one of level k - 1; the single
    node of the last level covers all. A leaf's digest is over the sorted digests of its rows (equal ones counted
    before they move), another's over those of its nodes. Null keys are node -1 of level 0. Compare two trees by a join.
    """
    digest = row_digest(sorted(df.columns)).alias("digest")
    counted = df.select(F.coalesce(F.floor(F.col(key) / span), F.lit(-1)).cast("long").alias("node"), digest).groupBy("node", "digest").agg(F.count("*").alias("n"))
    folded = lambda text: F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "|"), 256).alias("digest")
    level = cut(counted.groupBy("node").agg(F.sum("n").alias("row_count"), folded(F.concat_ws("*", "digest", F.col("n").cast("string")))))
    out = [level.withColumn("level", F.lit(0))]
    for k in range(1, levels + 1):
        up = F.lit(0).cast("long") if k == levels else F.floor(F.col("node") / fan).cast("long")
        # a node's number, with leading zeros, and its digest
        child = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), "digest")
        level = cut(level.select(up.alias("up"), "row_count", child.alias("child")).groupBy(F.col("up").alias("node")).agg(F.sum("row_count").alias("row_count"), folded(F.col("child"))))
        out.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.unionByName, out).select("level", "node", "row_count", "digest")
