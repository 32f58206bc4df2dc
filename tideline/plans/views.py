"""Posts, bars, calendar, trades and reviews derived from the driver's tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Rules, Settings
from ..functions.rules import classify, unmatched
from ..operators.temporal import forward_asof

#: Bars are hourly here, so horizons are hours.
HOURLY = Settings(horizons=(60, 180, 360), whipsaw_minutes=360, whipsaw_first_minutes=120, daily_loss=50.0, maximum_loss=500.0, trailing_drawdown=250.0)
#: Frequent words of the invented prose, so that rules fire.
CORPUS_RULES = Rules(
    topics={"alpha": ["the", "and"], "beta": ["that", "with", "by"], "gamma": ["of the", "for"], "delta": ["der", "und"], "epsilon": ["les", "dans"], "zeta": ["las", "por"]},
    bullish=["from", "at"],
    bearish=["was", "it is", "are"],
    geopolitical=["von", "pour"],
    neutral=["los", "es"],
    market_topics=["alpha", "gamma"],
    relevant_topics=["alpha", "beta", "delta"],
)
TS = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")


def iso_sql(ts: str) -> str:
    """SQL of events.iso()."""
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 <> 0 THEN '.' || strftime({ts}, '%f') ELSE '' END || '+00:00'"


def text_ts(c: str):
    return F.date_format(c, TS).alias(c)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the values of views, clicks and purchases."""
    key = F.struct("ts", "event_id")
    rows = events(spark, sf_dir).where("event_type in ('view', 'click', 'purchase') and value is not null")
    return rows.groupBy(F.date_trunc("hour", "ts").alias("ts_open_utc")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("volume")
    )


def full_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with all columns; every fiftieth hour is invalid."""
    hour = F.floor(F.unix_timestamp("ts_open_utc") / 3600)
    return bars(spark, sf_dir).withColumns(
        {
            "symbol_root": F.lit("NQ"), "contract_symbol": F.lit("NQH4"), "continuous_symbol": F.lit("NQ.c.0"), "ts_close_utc": F.expr("ts_open_utc + interval 1 hour"), "trade_count": F.col("volume"),
            "vwap": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4, "source_name": F.lit("events"), "session_id": F.date_format("ts_open_utc", "yyyy-MM-dd"), "is_valid_bar": hour % 50 != 0,
        }
    )


def posts(spark: SparkSession, sf_dir: str, *, text: bool = False, numbered: bool = False) -> DataFrame:
    """Sign-ups as posts; the text is that of the document numbered by event id modulo the number of documents. numbered: with doc_id only."""
    rows = events(spark, sf_dir).where("event_type = 'signup'")
    out = rows.select(F.col("event_id").cast("string").alias("post_id"), F.col("user_id").cast("string").alias("author_id"), F.col("ts").alias("received_at_utc"), F.expr("ts - interval 2 seconds").alias("created_at_utc"), "event_id", "value")
    if not text and not numbered:
        return out.drop("event_id")
    docs = table(spark, sf_dir, "documents")
    out = out.withColumn("doc_id", F.col("event_id") % docs.count())
    if numbered:
        return out.drop("event_id")
    return out.join(docs.select("doc_id", F.col("text").alias("text_clean")), "doc_id", "left").drop("event_id")


def labelled(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a doc_id and the rule labels of that document: every document is classified once, however many posts have its text."""
    rules = classify(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_clean")), rules=CORPUS_RULES).drop("text_clean")
    out = rows.join(rules, "doc_id", "left")
    return out.withColumns({k: F.coalesce(F.col(k), c) for k, c in unmatched(CORPUS_RULES).items()})


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All error events as calendar."""
    rows = events(spark, sf_dir).where("event_type = 'error'")
    kind, weight = F.concat(F.lit("kind_"), (F.col("event_id") % 3).cast("string")), F.when(F.col("event_id") % 100 == 0, "high").otherwise("medium")
    return rows.select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("scheduled_at_utc"), kind.alias("event_type"), weight.alias("importance"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as trades of three hours, priced by the next bar's open and close."""
    rows = events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("trade_id"), F.col("ts").alias("entry_ts_utc"), F.expr("ts + interval 3 hours").alias("exit_ts_utc"),
        F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("side"), (1 + F.col("event_id") % 3).cast("int").alias("contracts"),
    )
    b = bars(spark, sf_dir)
    entry = forward_asof(rows, b.select("ts_open_utc", "open"), "entry_ts_utc", "ts_open_utc", name="_in")
    both = forward_asof(entry, b.select("ts_open_utc", "close"), "exit_ts_utc", "ts_open_utc", name="_out")
    priced = both.withColumns({"entry_price": F.col("_in.open"), "exit_price": F.col("_out.close")}).drop("_in", "_out")
    return priced.where("entry_price is not null and exit_price is not null")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as reviews: reviewer `q` gives the quality, reviewer `t` the toxicity."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("event_id"), F.explode(F.array(F.struct(F.lit("q").alias("reviewer_id"), F.col("quality").alias("label")), F.struct(F.lit("t").alias("reviewer_id"), F.col("toxic").alias("label")))).alias("x"))
    return rows.select("event_id", "x.reviewer_id", F.col("x.label").cast("string").alias("label"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in order of id with a rule's prediction and class probabilities: long texts are said to be good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").where("quality is not null").join(docs, "doc_id")
    p1 = F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("n_chars") / 4096.0)), 4)
    return rows.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("actual"), p1.alias("p_good"), F.round(1 - p1, 4).alias("p_bad"), F.when(p1 >= 0.5, "good").otherwise("bad").alias("predicted"), F.greatest(p1, F.round(1 - p1, 4)).alias("confidence"))


BASE_SQL = """
bars AS (SELECT date_trunc('hour', ts) AS ts_open_utc, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume
  FROM events WHERE event_type IN ('view', 'click', 'purchase') AND ts IS NOT NULL AND value IS NOT NULL GROUP BY 1),
posts AS (SELECT event_id::VARCHAR AS post_id, user_id::VARCHAR AS author_id, ts AS received_at_utc, ts - INTERVAL 2 SECOND AS created_at_utc, value, event_id % (SELECT count(*) FROM documents) AS doc_id FROM events WHERE event_type = 'signup' AND ts IS NOT NULL),
calendar AS (SELECT event_id::VARCHAR AS event_id, ts AS scheduled_at_utc, 'kind_' || (event_id % 3)::VARCHAR AS event_type, CASE WHEN event_id % 100 = 0 THEN 'high' ELSE 'medium' END AS importance FROM events WHERE event_type = 'error' AND ts IS NOT NULL)"""
ALIGNED_SQL = BASE_SQL + """,
aligned AS (SELECT p.*, b.ts_open_utc AS aligned_ts, b.open AS base_price FROM posts p ASOF LEFT JOIN bars b ON p.received_at_utc <= b.ts_open_utc),
horizon AS (SELECT a.*, h.horizon, a.aligned_ts + h.horizon * INTERVAL 1 MINUTE AS at FROM aligned a, (VALUES (60), (180), (360)) h(horizon) WHERE a.aligned_ts IS NOT NULL),
target AS (SELECT h.*, b.ts_open_utc AS target_ts, b.close AS target_close, round((b.close - h.base_price) / 0.25, 4) AS delta_ticks FROM horizon h ASOF LEFT JOIN bars b ON h.at <= b.ts_open_utc),
steps AS (SELECT *, close - lag(close) OVER (ORDER BY ts_open_utc) AS step FROM bars),
windowed AS (SELECT t.post_id, t.horizon, t.delta_ticks, CASE WHEN t.delta_ticks >= 4 THEN 'up' WHEN t.delta_ticks <= -4 THEN 'down' ELSE 'flat' END AS direction,
    round(greatest((max(s.high) - t.base_price) / 0.25, 0), 4) AS mfe_ticks, round(greatest((t.base_price - min(s.low)) / 0.25, 0), 4) AS mae_ticks, round((max(s.high) - min(s.low)) / 0.25, 4) AS range_ticks,
    round(sqrt(coalesce(sum(CASE WHEN s.ts_open_utc > t.aligned_ts THEN (s.step / 0.25) * (s.step / 0.25) END), 0)), 4) AS volatility_ticks
  FROM target t JOIN steps s ON s.ts_open_utc BETWEEN t.aligned_ts AND t.target_ts GROUP BY t.post_id, t.horizon, t.delta_ticks, t.base_price),
path AS (SELECT a.post_id, a.base_price, list(b.high ORDER BY b.ts_open_utc) AS highs, list(b.low ORDER BY b.ts_open_utc) AS lows,
    max(b.high) FILTER (b.ts_open_utc <= a.aligned_ts + INTERVAL 120 MINUTE) AS first_high, min(b.low) FILTER (b.ts_open_utc <= a.aligned_ts + INTERVAL 120 MINUTE) AS first_low
  FROM aligned a JOIN bars b ON b.ts_open_utc BETWEEN a.aligned_ts AND a.aligned_ts + INTERVAL 360 MINUTE GROUP BY a.post_id, a.base_price),
moves AS (SELECT *, (first_high - base_price) / 0.25 AS up, (base_price - first_low) / 0.25 AS down,
    list_max(highs) - list_min(lows[list_position(highs, list_max(highs)):]) AS from_top, list_max(highs[list_position(lows, list_min(lows)):]) - list_min(lows) AS from_bottom FROM path),
flagged AS (SELECT post_id, greatest(up, down) >= 20 AND (CASE WHEN up >= down THEN from_top ELSE from_bottom END) / 0.25 >= greatest(greatest(up, down) * 0.65, 15) AS market_whipsaw_flag FROM moves),
wide AS (SELECT post_id, count(*) AS n, max(delta_ticks) FILTER (horizon = 60) AS d60, max(delta_ticks) FILTER (horizon = 180) AS d180, max(delta_ticks) FILTER (horizon = 360) AS d360,
    max(range_ticks) FILTER (horizon = 360) AS r360, max(volatility_ticks) FILTER (horizon = 360) AS v360 FROM windowed GROUP BY 1),
evt AS (SELECT a.*, w.d60, w.d180, w.d360, w.r360, w.v360, f.market_whipsaw_flag, substr(sha256(a.post_id || '|' || strftime(a.aligned_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(a.aligned_ts) % 1000000 <> 0 THEN '.' || strftime(a.aligned_ts, '%f') ELSE '' END || '+00:00'), 1, 16) AS event_id,
    CASE WHEN f.market_whipsaw_flag THEN 'no_trade_whipsaw' WHEN r360 >= 35 AND abs(d360) < 12 THEN 'volatility_only' WHEN abs(d180) >= 8 THEN 'tradeable_directional' WHEN abs(d360) <= 4 THEN 'no_impact' ELSE 'ambiguous' END AS tradeability_label
  FROM aligned a JOIN wide w ON w.post_id = a.post_id AND w.n = 3 JOIN flagged f ON f.post_id = a.post_id),
named AS (SELECT scheduled_at_utc, first(event_id ORDER BY event_id) AS event_id, first(event_type ORDER BY event_id) AS event_type, first(importance ORDER BY event_id) AS importance FROM calendar GROUP BY 1),
later AS (SELECT p.*, c AS nxt FROM posts p ASOF LEFT JOIN named c ON p.received_at_utc <= c.scheduled_at_utc),
around AS (SELECT l.*, c AS prv FROM later l ASOF LEFT JOIN named c ON l.received_at_utc >= c.scheduled_at_utc),
macro AS (SELECT post_id, c, (epoch_us(c.scheduled_at_utc) - epoch_us(received_at_utc)) / 60000000.0 AS m FROM (SELECT *, CASE WHEN prv.scheduled_at_utc IS NULL OR epoch_us(nxt.scheduled_at_utc) - epoch_us(received_at_utc) < epoch_us(received_at_utc) - epoch_us(prv.scheduled_at_utc) THEN nxt ELSE prv END AS c FROM around)),
gaps AS (SELECT *, epoch_us(received_at_utc) - lag(epoch_us(received_at_utc)) OVER w AS since, lead(epoch_us(received_at_utc)) OVER w - epoch_us(received_at_utc) AS until FROM evt WINDOW w AS (ORDER BY received_at_utc, post_id)),
numbered AS (SELECT *, sum(CASE WHEN since <= 21600000000 THEN 0 ELSE 1 END) OVER (ORDER BY received_at_utc, post_id) AS cluster FROM gaps)"""


def rules_sql(rules: Rules = CORPUS_RULES, source: str = "posts p JOIN documents d ON d.doc_id = p.doc_id") -> str:
    """CTE `labelled`: post_id, received_at_utc, topics (list), sentiment, confidence, tradeability, reasons (list)."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    hit = lambda k: f"contains(t, {quote(k)})" if " " in k else rf"regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_]){k}($|[^\p{{L}}\p{{N}}_])')"
    found = lambda words: "[k for k in [" + ", ".join(f"CASE WHEN {hit(k)} THEN {quote(k)} END" for k in words) + "] if k IS NOT NULL]"
    topics = ", ".join(f"{{'s': -round(least(0.95, 0.5 + 0.15 * len({found(words)})), 4)::DOUBLE, 'i': {i}, 'n': len({found(words)}), 't': {quote(t)}}}" for i, (t, words) in enumerate(rules.topics.items()))
    market = "[" + ", ".join(map(quote, rules.market_topics)) + "]"
    return f""",
texts AS (SELECT p.post_id, p.received_at_utc, lower(coalesce(d.text, '')) AS t FROM {source}),
matched AS (SELECT post_id, received_at_utc, list_sort([x for x in [{topics}] if x.n > 0]) AS scored, {found(rules.geopolitical)} AS geo, {found(rules.bullish)} AS bull, {found(rules.bearish)} AS bear, {found(rules.neutral)} AS neut FROM texts),
decided AS (SELECT *, CASE WHEN len(scored) > 0 THEN [x.t for x in scored] ELSE ['{rules.other}'] END AS topics, CASE WHEN len(scored) > 0 THEN -scored[1].s ELSE 0 END AS boost,
  CASE WHEN len(geo) > 0 THEN 'geopolitical_risk' WHEN len(bull) > 0 AND len(bear) = 0 THEN 'bullish_market' WHEN len(bear) > 0 AND len(bull) = 0 THEN 'bearish_market' WHEN len(bull) > 0 THEN 'volatility_only' WHEN len(neut) > 0 THEN 'neutral' ELSE 'low_confidence' END AS sentiment FROM matched),
sure AS (SELECT *, CASE sentiment WHEN 'volatility_only' THEN 0.62 WHEN 'neutral' THEN 0.68 WHEN 'low_confidence' THEN 0.45
  ELSE round(least(0.95, 0.55 + 0.1 * len(CASE sentiment WHEN 'geopolitical_risk' THEN geo WHEN 'bullish_market' THEN bull ELSE bear END) + 0.15 * boost), 4) END::DOUBLE AS confidence FROM decided),
labelled AS (SELECT post_id, received_at_utc, topics, sentiment, confidence, CASE WHEN confidence < 0.5 THEN 'ambiguous' WHEN sentiment = 'geopolitical_risk' THEN 'volatility_only' WHEN sentiment IN ('bullish_market', 'bearish_market') THEN CASE WHEN list_has_any(topics, {market}) THEN 'tradeable_directional' ELSE 'ambiguous' END
  WHEN sentiment = 'volatility_only' THEN 'volatility_only' WHEN sentiment = 'neutral' THEN 'no_impact' ELSE 'ambiguous' END AS tradeability FROM sure)"""


def event_frame(spark: SparkSession, sf_dir: str, *, numbered: bool = False, macro: bool = False):
    """build_events() over the derived tables: events and skipped posts."""
    from ..operators.events import build_events

    return build_events(posts(spark, sf_dir, numbered=numbered), bars(spark, sf_dir), calendar(spark, sf_dir) if macro else None, HOURLY)
