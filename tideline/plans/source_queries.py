"""Queries over sources, sinks and streams: the driver's tables are landed in the shared folder in the form that a reader takes, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import quality
from ..operators.events import iso
from ..operators.temporal import shared_folder
from ..sources import market, posts, sinks, tables
from ..streaming import live
from . import views as v
from .risk_queries import RISK_SQL
from .views import BASE_SQL, iso_sql, rules_sql, text_ts

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def place(spark, name):
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/landed-{uuid.uuid4().hex}/{name}"


def signups(spark, d):
    return v.events(spark, d).where("event_type = 'signup'")


Z = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
SIGNUPS = "s AS (SELECT * FROM events WHERE event_type = 'signup' AND ts IS NOT NULL)"


@query(f"""WITH {SIGNUPS} SELECT event_id::VARCHAR AS post_id, {iso_sql('ts')} AS created, 'Value & ' || user_id::VARCHAR || ' URL' AS text_clean, 'https://a.example/' || event_id::VARCHAR || ',https://b.example/' || event_id::VARCHAR AS urls, event_id % 2 = 0 AS has_image, event_id % 2 = 1 AS has_video, user_id AS replies,
sha256(event_id::VARCHAR || '|Value & ' || user_id::VARCHAR || ' URL|https://c.example/' || event_id::VARCHAR || CASE WHEN event_id % 2 = 0 THEN '.JPG' ELSE '.mp4' END) AS content_hash FROM s""")
def s1_archive_posts(spark, d):
    """JSON lines of archive rows; every row is there twice and is taken once."""
    n = F.col("event_id").cast("string")
    media = F.concat(F.lit("https://c.example/"), n, F.when(F.col("event_id") % 2 == 0, ".JPG").otherwise(".mp4"))
    rows = signups(spark, d).select(
        n.alias("id"), F.date_format("ts", Z).alias("created_at"), F.concat(F.lit("<b>Value</b> &amp; "), F.col("user_id").cast("string"), F.lit("  https://a.example/"), n).alias("content"),
        F.concat(F.lit("https://b.example/"), n).alias("url"), F.array(media).alias("media"), F.col("user_id").alias("replies_count"),
    )
    path = place(spark, "archive.jsonl")
    sinks.write_report(rows.unionByName(rows), path)
    out = posts.load_archive(spark, path, dedupe=True)
    return out.select("post_id", iso(F.col("created_at_utc")).alias("created"), "text_clean", F.array_join("urls", ",").alias("urls"), "has_image", "has_video", F.col("engagement.replies_count").alias("replies"), "content_hash")


@query(f"WITH {SIGNUPS} SELECT event_id::VARCHAR AS post_id, {iso_sql('ts')} AS created, '}}] {{[ \"' || user_id::VARCHAR || '\"' AS text_clean, user_id AS replies FROM s")
def s1_array_posts(spark, d):
    """Files that are one JSON array each, of texts with brackets and quotes."""
    n = F.col("event_id").cast("string")
    rows = signups(spark, d).select(F.floor(F.col("event_id") / 1_000).alias("file"), F.to_json(F.struct(n.alias("id"), F.date_format("ts", Z).alias("created_at"), F.concat(F.lit('}] {[ "'), F.col("user_id").cast("string"), F.lit('"')).alias("content"), F.col("user_id").alias("replies_count"))).alias("json"))
    path = place(spark, "arrays.json")
    # a thousand ids to a file at most
    rows.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("json"), ",\n"), F.lit("]")).alias("value")).write.partitionBy("file").text(path)
    return posts.load_archive(spark, path).select("post_id", iso(F.col("created_at_utc")).alias("created"), "text_clean", F.col("engagement.replies_count").alias("replies"))


@query(f"WITH {SIGNUPS} SELECT event_id::VARCHAR AS post_id, user_id::VARCHAR AS author_id, CASE WHEN event_id % 3 = 0 THEN 'reply' WHEN event_id % 3 = 1 THEN 'unknown' ELSE 'original' END AS post_type, user_id AS likes, epoch_us(ts) // 1000 AS created_ms, epoch_us(ts) // 1000 + 9000 AS received_ms FROM s")
def s5_provider_posts(spark, d):
    """Parquet under other names than the canonical ones, with two receipts of every post."""
    kind = F.when(F.col("event_id") % 3 == 0, "Reply").when(F.col("event_id") % 3 == 1, "").otherwise("strange")
    rows = signups(spark, d).select(F.col("event_id").alias("postId"), F.unix_millis("ts").alias("createdAt"), F.explode(F.array(F.lit(9000), F.lit(4000))).alias("late"), F.struct(F.col("user_id").cast("string").alias("id")).alias("account"), kind.alias("kind"), F.col("user_id").cast("string").alias("likes"), F.lit("same").alias("content"))
    path = place(spark, "provider.parquet")
    sinks.write_table(rows.withColumn("fetchedAt", F.col("createdAt") + F.col("late")).drop("late"), path)
    out = posts.load_provider(spark, path)
    return out.select("post_id", "author_id", "post_type", F.col("engagement.favourites_count").alias("likes"), F.unix_millis("created_at_utc").alias("created_ms"), F.unix_millis("received_at_utc").alias("received_ms"))


@query(f"WITH {SIGNUPS} SELECT event_id::VARCHAR AS post_id, CASE WHEN event_id % 4 = 0 THEN 'quote' WHEN event_id % 4 = 1 THEN 'reply' ELSE 'original' END AS post_type, 'Hi there' AS text_clean, epoch_us(ts) // 1000 AS created_ms FROM s")
def s7_statuses(spark, d):
    """Status rows with marked-up content; the type follows from quote and reply fields."""
    n = F.col("event_id")
    rows = signups(spark, d).select(n.cast("string").alias("id"), F.date_format("ts", Z).alias("created_at"), F.lit("<p>Hi<br>there</p>").alias("content"), F.when(n % 4 == 0, "q").alias("quote_id"), F.when(n % 4 == 1, "r").alias("in_reply_to_id"))
    path = place(spark, "statuses.jsonl")
    sinks.write_report(rows, path)
    out = posts.normalise_statuses(posts.read_rows(spark, path), received_at="2030-01-01T00:00:00Z")
    return out.select("post_id", "post_type", "text_clean", F.unix_millis("created_at_utc").alias("created_ms"))


@query(f"WITH {SIGNUPS} SELECT 'g' || event_id::VARCHAR AS post_id, epoch_us(date_trunc('second', ts)) // 1000 AS created_ms, 'Text & ' || user_id::VARCHAR AS text_clean, CASE WHEN event_id % 2 = 0 THEN 'reply' ELSE 'original' END AS post_type, 'me' AS author_id FROM s")
def s6_feed_items(spark, d):
    """RSS items as XML, with dates in the form of mail headers."""
    rows = signups(spark, d).select(
        F.when(F.col("event_id") % 2 == 0, "RT @x").otherwise("Title").alias("title"), F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("guid"), F.date_format("ts", "d MMM yyyy HH:mm:ss '+0000'").alias("pubDate"),
        F.concat(F.lit("<i>Text</i> &amp; "), F.col("user_id").cast("string")).alias("description"), F.lit("@me").alias("author"),
    )
    path = place(spark, "feed.xml")
    rows.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return posts.load_feed(spark, path).select("post_id", F.unix_millis("created_at_utc").alias("created_ms"), "text_clean", "post_type", "author_id")


VENDOR = "vendor AS (SELECT ts_open_utc, (open + 100) * 1e9::DOUBLE / 1e9::DOUBLE AS open, (high + 100) * 1e9::DOUBLE / 1e9::DOUBLE AS high, (low + 100) * 1e9::DOUBLE / 1e9::DOUBLE AS low, (close + 100) * 1e9::DOUBLE / 1e9::DOUBLE AS close, volume FROM bars)"


@query(f"WITH {BASE_SQL}, {VENDOR} SELECT strftime(ts_open_utc, '%Y-%m-%d %H:%M:%S') AS ts_open_utc, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, round((open + high + low + close) / 4, 5) AS vwap, 'SYM' AS contract_symbol, strftime(ts_open_utc, '%Y-%m-%d') AS session_id, true AS is_valid_bar FROM vendor")
def s9_vendor_bars(spark, d):
    """CSV of a vendor: other names, prices in units of 1e-9, no mean price; each bar is there twice."""
    price = lambda c: ((F.col(c) + 100) * 1e9).alias(c.capitalize())
    rows = v.bars(spark, d).select(F.date_format("ts_open_utc", Z).alias("ts_event"), F.lit("SYM").alias("symbol"), *(price(c) for c in ("open", "high", "low", "close")), F.col("volume").alias("Volume"))
    path = place(spark, "vendor.csv")
    sinks.write_table(rows.unionByName(rows), path)
    out = market.load_vendor_bars(spark, path)
    return out.select(text_ts("ts_open_utc"), *(F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")), "volume", F.round("vwap", 5).alias("vwap"), "contract_symbol", "session_id", "is_valid_bar")


@query(f"WITH {BASE_SQL} SELECT strftime(ts_open_utc, '%Y-%m-%d %H:%M:%S') AS ts_open_utc, open, close, volume, epoch_us(ts_open_utc) // 3600000000 % 50 <> 0 AS is_valid_bar, CASE WHEN volume % 2 = 0 THEN 'unknown symbol' ELSE '' END AS problems FROM bars")
def s8_canonical_bars(spark, d):
    """Canonical bars as CSV; those with an even volume have a symbol that isn't known."""
    stamp = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in ("ts_open_utc", "ts_close_utc")}
    rows = v.full_bars(spark, d).withColumns({"symbol_root": F.when(F.col("volume") % 2 == 0, "ES").otherwise("MNQ"), "is_rth": F.lit("Yes"), "is_rollover_period": F.lit("0"), "is_holiday_session": F.lit("no")} | stamp)
    path = place(spark, "bars.csv")
    sinks.write_table(rows, path)
    out = quality.bar_problems(market.load_bars(spark, path))
    return out.select(text_ts("ts_open_utc"), "open", "close", "volume", "is_valid_bar", F.array_join("problems", ",").alias("problems"))


@query(f"WITH {BASE_SQL} SELECT event_id, event_type, importance, strftime(scheduled_at_utc, '%Y-%m-%d %H:%M:%S') AS scheduled_at_utc FROM calendar")
def s12_calendar(spark, d):
    rows = v.calendar(spark, d).withColumns({"event_name": F.lit("name"), "scheduled_at_utc": F.date_format("scheduled_at_utc", Z)})
    path = place(spark, "calendar.csv")
    sinks.write_table(rows, path)
    return market.load_calendar(spark, path).select("event_id", "event_type", "importance", text_ts("scheduled_at_utc"))


@query("SELECT event_id::VARCHAR AS trade_id, epoch_us(ts) AS entry_us, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, (1 + event_id % 3)::INTEGER AS contracts, value AS entry_price FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL")
def s13_trades(spark, d):
    n = F.col("event_id")
    rows = v.events(spark, d).where("event_type = 'purchase'").select(n.alias("trade_id"), F.date_format("ts", Z).alias("entry_ts_utc"), F.date_format("ts", Z).alias("exit_ts_utc"), F.when(n % 2 == 0, "long").otherwise("short").alias("side"), (1 + n % 3).alias("contracts"), F.col("value").alias("entry_price"), F.col("value").alias("exit_price"))
    path = place(spark, "trades.csv")
    sinks.write_table(rows, path)
    return market.load_trades(spark, path).select("trade_id", F.unix_micros("entry_ts_utc").alias("entry_us"), "side", "contracts", "entry_price")


@query("SELECT doc_id::VARCHAR AS event_id, 'v1' AS label_version, (CASE WHEN toxic = 1 THEN 1 ELSE 0 END + CASE WHEN quality = 0 THEN 1 ELSE 0 END)::INTEGER AS problems FROM labels")
def s14_reviews(spark, d):
    """Labels as a review file: toxic rows have a sentiment that isn't known, bad ones a confidence beyond 1."""
    text = {"post_id": "p", "human_tradeability_label": "ambiguous", "human_topic_labels": "trade_policy|other", "market_relevance_label": "uncertain", "contradiction_label": "none", "reviewer_id": "r", "reviewed_at_utc": "2026-01-02T10:00:00Z", "review_notes": "-"}
    rows = v.table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), F.when(F.col("toxic") == 1, "glad").otherwise("neutral").alias("human_sentiment_label"), F.when(F.col("quality") == 0, "1.5").otherwise("0.5").alias("label_confidence"), *(F.lit(x).alias(c) for c, x in text.items()))
    path = place(spark, "reviews.csv")
    sinks.write_table(rows, path)
    return market.load_reviews(spark, path, label_version="v1").select("event_id", "label_version", F.size("problems").alias("problems"))


@query(f"WITH {SIGNUPS} SELECT event_id, epoch_us(CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) WHEN 2 THEN ts END) AS micros FROM s")
def f18_timestamps(spark, d):
    """Epoch seconds, epoch milliseconds, ISO with an offset, and ISO without one, which is refused."""
    k = F.col("event_id") % 4
    ahead = F.date_format(F.expr("ts + interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+01:30'")
    text = F.when(k == 0, F.unix_timestamp("ts").cast("string")).when(k == 1, F.unix_millis("ts").cast("string")).when(k == 2, ahead).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return signups(spark, d).select("event_id", F.unix_micros(quality.any_timestamp(text)).alias("micros"))


COLLECTED = f"WITH {SIGNUPS} SELECT (event_id % 300)::VARCHAR AS post_id, 'v' || (user_id % 3)::VARCHAR AS text_clean, max(epoch_us(ts)) AS received_us FROM s GROUP BY ALL"


@query(COLLECTED)
def r1_collected_posts(spark, d):
    """Rows that land as files are collected by a stream: the newest receipt of each version of a post stays."""
    rows = signups(spark, d).select((F.col("event_id") % 300).cast("string").alias("id"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.date_format("ts", Z).alias("received_at"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("content"))
    landing, table = place(spark, "landing"), place(spark, "table")
    rows.repartition(4).write.json(landing)
    stream = live.landed(spark, landing, T.StructType([T.StructField(c, T.StringType()) for c in rows.columns]), max_files=2)
    live.collect(stream, table=table, raw_log=place(spark, "raw"), checkpoint=place(spark, "stream"), normalise=posts.normalise_statuses, once=True).awaitTermination()
    return tables.read_table(spark, table).select("post_id", "text_clean", F.unix_micros("received_at_utc").alias("received_us"))


@query(COLLECTED)
def r2_newest_versions(spark, d):
    """Landed rows through keyed state: what is passed on last of a version is its newest receipt."""
    rows = signups(spark, d).select((F.col("event_id") % 300).cast("string").alias("post_id"), F.date_format("ts", Z).alias("received_at_utc"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("text_clean"))
    landing, table, name = place(spark, "landing"), place(spark, "table"), "spark.sql.streaming.stateStore.providerClass"
    rows.withColumn("content_hash", F.sha2("text_clean", 256)).repartition(4).write.json(landing)
    stream = live.landed(spark, landing, T.StructType.fromDDL("post_id string, received_at_utc timestamp, text_clean string, content_hash string"), max_files=2)
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # files land in no order of time, so that nothing is late here
        found = live.newest_seen(stream, minutes=10 * 366 * 24 * 60).writeStream.outputMode("update").option("checkpointLocation", place(spark, "stream"))
        found.foreachBatch(lambda df, number: tables.upsert(df, table, writer="r2", batch=number) and None).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return tables.read_table(spark, table).select("post_id", "text_clean", F.unix_micros("received_at_utc").alias("received_us"))


@query(COLLECTED)
def k4_upserted_posts(spark, d):
    """The same by two upserts of a half each."""
    rows = signups(spark, d).select((F.col("event_id") % 300).cast("string").alias("post_id"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("text_clean"), F.col("ts").alias("received_at_utc"), F.date_trunc("day", F.timestamp_seconds((F.col("event_id") % 300) * 86_400)).alias("created_at_utc"), "value").withColumn("content_hash", F.col("text_clean"))
    table = place(spark, "table")
    tables.upsert(rows.where("value < 20"), table)
    tables.upsert(rows.where("value >= 20 or value is null"), table)
    return tables.read_table(spark, table).select("post_id", "text_clean", F.unix_micros("received_at_utc").alias("received_us"))


@query(f"WITH {BASE_SQL} SELECT 'events' AS source, 200 > 10 AS is_stale, 200::BIGINT AS lag_seconds, 202::BIGINT AS latest_post_age_seconds, count(*) AS canonical_rows, count(*) AS raw_rows, count(*) - count(DISTINCT author_id) AS duplicate_rows FROM posts")
def r3_collector_health(spark, d):
    """Health at 200 seconds after the last receipt; ids of raw rows are the authors here."""
    rows = v.posts(spark, d)
    last = rows.agg(F.date_format(F.max("received_at_utc") + F.expr("interval 200 seconds"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    return live.health(rows, source="events", checked_at=last, raw=rows, id_col="author_id").select("source", "is_stale", "lag_seconds", "latest_post_age_seconds", "canonical_rows", "raw_rows", "duplicate_rows")


@query(f"WITH {BASE_SQL} {rules_sql()} {RISK_SQL} SELECT post_id, score AS whipsaw_score, lvl AS whipsaw_risk_level, ttl AS risk_ttl_seconds, prior, b.posts_last_60m, b.posts_last_240m FROM timed JOIN burst b USING (post_id)")
def r4_incremental_scores(spark, d):
    """Labelled posts that land roughly by time, every tenth of them days late, scored batch by batch."""
    rows = v.labelled(v.posts(spark, d, numbered=True), spark, d)
    lands = F.when(F.col("post_id").cast("long") % 10 == 0, F.expr("received_at_utc + interval 3 days")).otherwise(F.col("received_at_utc"))
    landing, table = place(spark, "landing"), place(spark, "table")
    rows.withColumn("_lands", lands).repartitionByRange(8, "_lands").drop("_lands").write.parquet(landing)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(landing)
    live.score_posts(stream, table=table, checkpoint=place(spark, "stream"), settings=v.HOURLY, rules=v.CORPUS_RULES, once=True).awaitTermination()
    found = tables.read_table(spark, table)
    return found.select("post_id", "whipsaw_score", "whipsaw_risk_level", "risk_ttl_seconds", F.get("contradicting_post_ids", F.lit(0)).alias("prior"), "posts_last_60m", "posts_last_240m")


@query(f"WITH {BASE_SQL} SELECT author_id AS event_id, arg_max(post_id, (received_at_utc, post_id)) AS post_id FROM posts GROUP BY 1")
def r5_latest_by_key(spark, d):
    """The newest row for each key, an author here."""
    rows = v.posts(spark, d).select(F.col("author_id").alias("event_id"), "post_id", "received_at_utc")
    return live.lookup(rows).select("event_id", "post_id")


@query(f"WITH {SIGNUPS} SELECT CASE WHEN event_id % 5 = 0 THEN 'received before created' WHEN event_id % 5 = 1 THEN 'unknown type' WHEN event_id % 5 = 2 THEN 'no receipt time' ELSE '' END AS problems, count(*) AS n FROM s GROUP BY 1")
def p4_post_problems(spark, d):
    k = F.col("event_id") % 5
    rows = signups(spark, d).select(F.col("ts").alias("created_at_utc"), F.when(k == 0, F.expr("ts - interval 1 second")).when(k != 2, F.col("ts")).alias("received_at_utc"), F.when(k == 1, "odd").otherwise("reply").alias("post_type"))
    return quality.post_problems(rows).groupBy(F.array_join("problems", ",").alias("problems")).agg(F.count("*").alias("n"))


@query(f"WITH {SIGNUPS} SELECT strftime(ts, '%Y-%m-%d') AS day, 'b' || (event_id % 3)::VARCHAR AS batch, count(*) AS n, sum(user_id)::BIGINT AS users, max(epoch_us(ts)) AS last_us FROM s GROUP BY 1, 2")
def k3_raw_log(spark, d):
    """Three batches appended to the raw log, the second one again as after a retry, and read back by day."""
    rows = signups(spark, d).select(F.col("event_id").alias("post_id"), F.col("ts").alias("received_at_utc"), F.to_json(F.struct("user_id")).alias("raw_json"))
    path = place(spark, "raw")
    for k in (0, 1, 1, 2):
        sinks.append_raw(rows.where(F.col("post_id") % 3 == k), path, batch=f"b{k}")
    found = sinks.read_raw(spark, path, "post_id long, received_at_utc timestamp, raw_json string")
    users = F.get_json_object("raw_json", "$.user_id").cast("long")
    return found.groupBy(F.col("day").cast("string").alias("day"), "batch").agg(F.count("*").alias("n"), F.sum(users).alias("users"), F.max(F.unix_micros("received_at_utc")).alias("last_us"))


@query("""SELECT doc_id::VARCHAR AS post_id, CASE WHEN lang IS NULL THEN 'original' WHEN n_chars % 3 = 0 THEN 'retruth' WHEN n_chars % 3 = 1 THEN 'quote' ELSE 'reply' END AS post_type, coalesce(source || ' & ' || n_chars::VARCHAR || ' URL', '') AS text_clean,
CASE WHEN source IS NULL THEN '' ELSE 'https://' || source || '.example/' || doc_id::VARCHAR END AS urls, 1600000000000 + doc_id * 1000 AS created_ms, 1600000000000 + doc_id * 1000 + coalesce(n_chars, 0) AS received_ms FROM documents""")
def s7_document_statuses(spark, d):
    """A status for every document: type, text, addresses and times are of the row's own columns, and any of them may be missing."""
    n, kind = F.col("doc_id"), F.when(F.col("lang").isNotNull(), F.col("n_chars") % 3)
    stamp = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    at = 1_600_000_000_000 + n * 1_000
    address = F.concat(F.lit("https://"), "source", F.lit(".example/"), n.cast("string"))
    rows = v.table(spark, d, "documents").select(
        n.cast("string").alias("id"), stamp(at).alias("created_at"), stamp(at + F.coalesce("n_chars", F.lit(0))).alias("received_at"), F.concat(F.lit("<p>"), "source", F.lit("<br>&amp; "), F.col("n_chars").cast("string"), F.lit("</p> "), address).alias("content"),
        F.when(kind == 0, "b").alias("reblog"), F.when(kind == 1, "q").alias("quote_id"), F.when(kind == 2, "r").alias("in_reply_to_id"),
    )
    path = place(spark, "statuses.parquet")
    sinks.write_table(rows, path)
    out = posts.normalise_statuses(posts.read_rows(spark, path))
    return out.select("post_id", "post_type", "text_clean", F.array_join("urls", ",").alias("urls"), F.unix_millis("created_at_utc").alias("created_ms"), F.unix_millis("received_at_utc").alias("received_ms"))


@query(f"WITH {SIGNUPS} SELECT * FROM (VALUES (1, 'provider', 'empty'), (2, 'feed', 'failed'), (3, 'archive', 'used')) x(step, source, status), (SELECT count(*) AS posts, count(DISTINCT user_id) AS texts FROM s)")
def s15_first_source(spark, d):
    """Sources in order: an export without rows, a feed that isn't there, and an archive of all sign-ups; a fourth is never asked."""
    rows = signups(spark, d).select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", Z).alias("created_at"), F.col("user_id").cast("string").alias("content"))
    export, archive = place(spark, "export.parquet"), place(spark, "archive.jsonl")
    sinks.write_table(rows.where("false"), export)
    sinks.write_report(rows, archive)
    found, log = posts.first_source(spark, [("provider", lambda: posts.load_provider(spark, export)), ("feed", lambda: posts.load_feed(spark, place(spark, "feed.xml"))), ("archive", lambda: posts.load_archive(spark, archive)), ("never", lambda: posts.load_archive(spark, archive))])
    step = F.array_position(F.array(*map(F.lit, ("provider", "feed", "archive", "never"))), F.col("source")).cast("int")
    return log.select(step.alias("step"), "source", "status").crossJoin(F.broadcast(found.agg(F.count("*").alias("posts"), F.count_distinct("text_clean").alias("texts"))))
