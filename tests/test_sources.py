import json
import random

import market
import pytest
from pyspark.sql import functions as F

from tideline.operators import quality as q
from tideline.sources import json_arrays as arrays
from tideline.sources import market as m
from tideline.sources import posts as p
from tideline.sources import sinks
from tideline.sources import tables as t

ARCHIVE = [
    {"id": "2", "created_at": "2026-01-02T14:30:15Z", "received_at": "2026-01-02T14:30:17Z", "content": "See <b>this</b> &amp; https://a.example/x now", "url": "https://b.example/2", "media": ["https://c.example/p.JPG"], "replies_count": 3, "reblogs_count": None, "favourites_count": 1},
    {"id": "1", "created_at": "2026-01-01T14:30:15.250Z", "content": "", "url": "", "media": ["https://c.example/v.mp4"], "replies_count": 0, "reblogs_count": 0, "favourites_count": 0},
]
PROVIDER = [
    {"id": "a1", "created_at": "2026-01-02T10:00:00Z", "received_at": "2026-01-02T10:00:05Z", "text": "First", "media": ["https://c.example/1.png"], "replies": 2, "likes": "x", "authorId": "me", "url": "https://b.example/a1", "post_type": "Reply"},
    {"postId": "a2", "createdAt": 1767348000000, "content": "Second https://d.example/q", "media": [], "replyCount": 4, "account": {"id": "acc"}, "uri": "https://b.example/a2", "kind": "strange"},
]


def dump(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_archive(spark, tmp_path):
    rows = p.load_archive(spark, dump(tmp_path / "a.json", ARCHIVE)).collect()
    assert [r["post_id"] for r in rows] == ["1", "2"]
    assert rows[1]["text_clean"] == "See this & URL now" and rows[1]["urls"] == ["https://a.example/x", "https://b.example/2"]
    assert rows[1]["has_image"] and not rows[1]["has_video"] and rows[0]["has_video"]
    assert rows[1]["engagement"].asDict() == {"replies_count": 3, "reblogs_count": 0, "favourites_count": 1}
    assert rows[0]["received_at_utc"] == rows[0]["created_at_utc"]
    audit = q.audit_posts(p.load_archive(spark, str(tmp_path / "a.json"))).first()
    assert (audit["empty_text_rows"], audit["media_only_rows"], audit["max_feed_lag_ms"]) == (1, 1, 2000)
    assert p.load_archive(spark, dump(tmp_path / "d.json", ARCHIVE + ARCHIVE[:1]), dedupe=True).count() == 2


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"data": x}, lambda x: {"response": {"items": x}}, lambda x: {"results": {"posts": x}}])
def test_provider_aliases_and_wrappers(spark, tmp_path, wrap):
    rows = {r["post_id"]: r for r in p.load_provider(spark, dump(tmp_path / "p.json", wrap(PROVIDER))).collect()}
    assert set(rows) == {"a1", "a2"}
    assert rows["a1"]["post_type"] == "reply" and rows["a2"]["post_type"] == "original"
    assert rows["a1"]["engagement"]["favourites_count"] == 0 and rows["a2"]["engagement"]["replies_count"] == 4
    assert rows["a2"]["author_id"] == "acc" and rows["a2"]["urls"] == ["https://b.example/a2", "https://d.example/q"]
    assert str(rows["a2"]["created_at_utc"]) == "2026-01-02 10:00:00"


def test_empty_payload_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        p.load_provider(spark, dump(tmp_path / "e.json", {"data": {"none": 1}}))


def test_statuses(spark, tmp_path):
    rows = [{"id": "s1", "created_at": "2026-01-02T10:00:00Z", "content": "<p>Hi</p>", "in_reply_to_id": "s0", "quote_id": None, "account": {"id": "9"}, "media_attachments": [{"id": "m", "type": "image", "url": "https://c.example/i.webp"}], "replies_count": 1}]
    got = p.normalise_statuses(p.read_rows(spark, dump(tmp_path / "s.json", {"posts": rows})), received_at="2026-01-02T10:00:09Z").first()
    assert got["post_type"] == "reply" and got["author_id"] == "9" and got["text_clean"] == "Hi" and got["media_urls"] == ["https://c.example/i.webp"] and got["has_image"]
    assert (got["received_at_utc"] - got["created_at_utc"]).seconds == 9


FEED = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<item><title>One</title><link>https://f.example/posts/abc1</link><pubDate>Tue, 05 Jan 2026 08:15:00 +0000</pubDate><description>Calm &lt;a href="https://t.example/s"&gt;here&lt;/a&gt;.</description><guid isPermaLink="false">g1</guid><dc:creator>@me</dc:creator><media:content url="https://c.example/i.jpg"/></item>
<item><title>RT @x</title><link>https://f.example/posts/abc2</link><pubDate>2026-01-05T09:00:00Z</pubDate><description>RT again</description><dc:creator>me</dc:creator></item></channel></rss>"""


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    rows = p.load_feed(spark, str(tmp_path / "f.xml")).collect()
    assert [r["post_id"] for r in rows] == ["g1", "abc2"] and [r["post_type"] for r in rows] == ["original", "reply"]
    assert rows[0]["text_clean"] == "Calm here ."
    assert rows[0]["author_id"] == "me" and rows[0]["media_urls"] == ["https://c.example/i.jpg"] and str(rows[0]["created_at_utc"]) == "2026-01-05 08:15:00"
    assert p.load_feed(spark, str(tmp_path / "f.xml"), end="2026-01-04").count() == 0


def test_source_order(spark, tmp_path):
    path = dump(tmp_path / "a.json", ARCHIVE)
    found, log = p.first_source(spark, [("missing", lambda: p.load_provider(spark, str(tmp_path / "no.json"))), ("archive", lambda: p.load_archive(spark, path))])
    assert found.count() == 2 and [r["status"] for r in log.collect()] == ["failed", "used"]


def test_vendor_bars(spark):
    rows = [("2026-01-02T14:30:00Z", 20_000_000_000_000, 20_001_000_000_000, 19_999.0, 20_000.5, 5), ("2026-01-02T14:31:00Z", 20000.0, 20000.0, 20000.0, 20000.0, None)]
    df = spark.createDataFrame([(a, float(b), float(c), float(d), float(e), f) for a, b, c, d, e, f in rows], "ts_event string, Open double, High double, Low double, Close double, Volume long")
    got = m.normalise_bars(df, symbol_root="NQ").collect()
    assert got[0]["open"] == 20000.0 and got[0]["high"] == 20001.0 and got[1]["volume"] == 0 and got[0]["session_id"] == "2026-01-02" and got[0]["is_valid_bar"]
    assert m.normalise_bars(df.withColumn("symbol", F.lit("NQH6"))).first()["contract_symbol"] == "NQH6"


def test_bar_files_and_audit(spark, tmp_path):
    bars = market.full_bars(spark)
    sinks.write_table(bars.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in ("ts_open_utc", "ts_close_utc")}), str(tmp_path / "bars.csv"))
    loaded = m.load_bars(spark, str(tmp_path / "bars.csv"))
    assert loaded.count() == 75 and q.split_quarantine(q.bar_problems(loaded))[1].isEmpty()
    gap = loaded.where("ts_open_utc <> timestamp'2025-03-04 09:25:00'").withColumn("volume", F.when(F.minute("ts_open_utc").isin(10, 11), 0).otherwise(F.col("volume")))
    row = q.audit_bars(gap).first()
    assert (row["row_count"], row["expected_bars"], row["missing_bars"], row["gaps"], row["zero_volume_rows"], row["stale_bars"]) == (74, 75, 1, 1, 4, 0)
    audit = m.vendor_audit(bars, gap, {"symbols": "NQ"}).first()
    assert (audit["raw_row_count"], audit["row_count"], audit["request"]) == (75, 74, {"symbols": "NQ"})
    bad = loaded.limit(1).withColumns({"symbol_root": F.lit("ES"), "high": F.col("low") - 1, "ts_close_utc": F.col("ts_open_utc")})
    assert len(q.bar_problems(bad).first()["problems"]) == 3


def test_post_problems(spark):
    rows = [("2026-01-02 10:00:00", "2026-01-02 10:00:01", "reply"), ("2026-01-02 10:00:00", "2026-01-02 09:59:59", "odd"), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, post_type string").selectExpr("to_timestamp(a) as created_at_utc", "to_timestamp(b) as received_at_utc", "post_type")
    good, bad = q.split_quarantine(q.post_problems(df))
    assert good.count() == 1 and sorted(len(r["problems"]) for r in bad.collect()) == [2, 3]


def test_review_file(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("event_id,post_id,human_sentiment_label,human_tradeability_label,human_topic_labels,market_relevance_label,contradiction_label,label_confidence,reviewer_id,reviewed_at_utc,review_notes\ne1,p1,neutral,no_impact,other,uncertain,none,0.5,me,2026-01-02T10:00:00Z,\ne2,p2,glad,no_impact,other,uncertain,none,0.5,me,2026-01-02T10:00:00Z,x\n")
    got = m.load_reviews(spark, str(path), label_version="v3").orderBy("event_id").collect()
    assert [len(r["problems"]) for r in got] == [0, 1] and got[0]["label_version"] == "v3" and got[0]["human_topic_labels"] == ["other"]


def test_source_audits(spark, tmp_path):
    posts = p.load_archive(spark, dump(tmp_path / "a.json", ARCHIVE), source_name="one").unionByName(p.load_archive(spark, str(tmp_path / "a.json"), source_name="two"))
    assert {r["source_name"]: (r["row_count"], r["empty_text_rows"], r["max_feed_lag_ms"]) for r in q.audit_sources(posts).collect()} == {"one": (2, 1, 2000), "two": (2, 1, 2000)}


def test_small_tables(spark, tmp_path):
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    sinks.write_table(market.calendar(spark).withColumn("scheduled_at_utc", F.date_format("scheduled_at_utc", iso)), str(tmp_path / "c.csv"))
    sinks.write_table(market.trades(spark).withColumns({c: F.date_format(c, iso) for c in ("entry_ts_utc", "exit_ts_utc")}), str(tmp_path / "t.csv"))
    assert m.load_calendar(spark, str(tmp_path / "c.csv")).count() == 2
    assert [r["trade_id"] for r in m.load_trades(spark, str(tmp_path / "t.csv")).collect()] == ["t3", "t1", "t2"]
    with pytest.raises(ValueError):
        m.load_calendar(spark, str(tmp_path / "t.csv"))


def make_posts(spark, *rows):
    return spark.createDataFrame(rows, "post_id string, content_hash string, created string, received string, text string").selectExpr("post_id", "content_hash", "cast(created as timestamp) as created_at_utc", "cast(received as timestamp) as received_at_utc", "text")


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kathmandu"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_upsert_keeps_one_newest_row_a_key(spark, tmp_path, zone):
    path = str(tmp_path / "canonical")
    day, other = "2026-01-01T02:00:00Z", "2026-01-02T23:30:00Z"
    t.upsert(make_posts(spark, ("1", "h", day, "2026-01-01T02:00:01Z", "old"), ("2", "h", other, "2026-01-02T23:30:01Z", "second"), ("a", "h", None, "2026-01-01T00:00:00Z", "no day")), path)
    t.upsert(make_posts(spark, ("1", "h", other, "2026-01-01T02:00:09Z", "moved"), ("1", "k", day, "2026-01-01T02:00:02Z", "edit"), ("c", "h", None, "2026-01-01T00:00:00Z", "no day"), (None, None, day, None, "no key")), path)
    t.upsert(make_posts(spark, (None, None, None, "2026-01-01T02:00:09Z", "no key, newer"), ("2", "h", None, "2026-01-01T00:00:00Z", "older")), path)
    got = sorted((r["post_id"] or "", r["content_hash"] or "", r["text"]) for r in t.read_table(spark, path).collect())
    assert got == [("", "", "no key, newer"), ("1", "h", "moved"), ("1", "k", "edit"), ("2", "h", "second"), ("a", "h", "no day"), ("c", "h", "no day")]


def test_batches_count_once_and_uncommitted_files_dont(spark, tmp_path):
    path, first = str(tmp_path / "t"), make_posts(spark, ("1", "h", None, "2026-01-01T02:00:01Z", "one"))
    assert t.upsert(first, path, writer="w", batch=0) and not t.upsert(first.withColumn("text", F.lit("again")), path, writer="w", batch=0)
    assert t.upsert(first.withColumn("extra", F.lit(5)).withColumn("post_id", F.lit("2")), path, writer="other", batch=0)
    # a writer that died before its commit: data of the next number is there, no commit names it
    first.withColumn("_bucket", F.lit(3)).write.partitionBy("_bucket").parquet(f"{path}/data/v=3")
    (tmp_path / "t" / "commits" / "n=3").mkdir()
    assert sorted((r["post_id"], r["text"], r["extra"]) for r in t.read_table(spark, path).collect()) == [("1", "one", None), ("2", "one", 5)]
    assert t.upsert(make_posts(spark, ("3", "h", None, "2026-01-01T02:00:01Z", "three")), path, writer="w", batch=1)
    assert sorted(r["post_id"] for r in t.read_table(spark, path).collect()) == ["1", "2", "3"]
    assert t.upsert(first.where("false"), path, writer="w", batch=2) and t.last_commit(spark, path).writers == {"w": 2, "other": 0}
    with pytest.raises(ValueError):
        t.read_table(spark, str(tmp_path / "none"))


def test_raw_log_has_days_in_utc_and_a_batch_once(spark, tmp_path, zone):
    path, rows = str(tmp_path / "raw"), make_posts(spark, ("1", "h", None, "2026-01-01T02:00:01Z", "x"), ("2", "h", None, "2026-01-01T23:59:59Z", "x"), ("3", "h", None, None, "x"))
    for batch in ("w-0", "w-0", "w-1", None):
        sinks.append_raw(rows, path, batch=batch)
    days = {(str(r["day"]), r["batch"][:3]): r["count"] for r in spark.read.json(path).groupBy("day", "batch").count().collect()}
    assert days == {(d, b): n for d, n in (("2026-01-01", 2), ("None", 1)) for b in ("w-0", "w-1", "onc")}


def test_raw_log_is_read_back_whole_and_by_days(spark, tmp_path, zone):
    path, kept = str(tmp_path / "raw"), "post_id string, received_at_utc timestamp"
    rows = make_posts(spark, ("1", "h", None, "2026-01-01T23:59:59.123456Z", "a"), ("2", "h", None, "2026-01-02T00:00:00.000001Z", "b"), ("3", "h", None, "2026-01-03T12:00:00Z", None), ("4", "h", None, None, "d"))
    sinks.append_raw(rows.select("post_id", "received_at_utc"), path, batch="b")
    micros = lambda df: {r["post_id"]: (r["us"], str(r["day"]), r["batch"]) for r in df.select("post_id", "day", "batch", F.unix_micros("received_at_utc").alias("us")).collect()}
    noon = 1767441600_000000
    found = micros(sinks.read_raw(spark, path, kept))
    assert found == {"1": (noon - 129600_876544, "2026-01-01", "b"), "2": (noon - 129599_999999, "2026-01-02", "b"), "3": (noon, "2026-01-03", "b"), "4": (None, "None", "b")}
    part = sinks.read_raw(spark, path, kept, first_day="2026-01-02", last_day="2026-01-02")
    assert set(micros(part)) == {"2"}
    assert set(micros(sinks.read_raw(spark, path, kept, first_day="2026-01-02"))) == {"2", "3"}
    assert "PartitionFilters: [isnotnull(day" in part._jdf.queryExecution().executedPlan().toString()


def test_instants_dont_depend_on_the_zone(spark, tmp_path, zone):
    (tmp_path / "f.xml").write_text(FEED)
    feed = p.load_feed(spark, str(tmp_path / "f.xml"), start="2026-01-05", end="2026-01-05").select("post_id", F.unix_seconds("created_at_utc").alias("s")).collect()
    assert {r["post_id"]: r["s"] for r in feed} == {"g1": 1767600900, "abc2": 1767603600}
    rows = [{"id": "s1", "created_at": "2026-01-02T10:00:00Z", "content": "x"}]
    got = p.normalise_statuses(p.read_rows(spark, dump(tmp_path / "s.json", rows))).select((F.unix_seconds(F.current_timestamp()) - F.unix_seconds("received_at_utc")).alias("age")).first()
    assert 0 <= got["age"] < 600
    bars = spark.createDataFrame([("2026-01-02T23:30:00Z", 1.0, 1.0, 1.0, 1.0, 5)], "ts_event string, Open double, High double, Low double, Close double, Volume long")
    assert m.normalise_bars(bars).first()["session_id"] == "2026-01-02"


@pytest.mark.parametrize("indent", [None, 1])
def test_one_array_is_read_by_several_tasks(spark, tmp_path, indent):
    """Borders of splits fall anywhere: inside strings, escapes and nested objects."""
    rng = random.Random(2)
    odd = ["}", "{", "]", "[", '"', "\\", '\\"', "},{", "\n", "é漢😀", '"}]', "text ", "\\\\"]
    rows = [{"id": str(n), "content": "".join(rng.choice(odd) for _ in range(rng.randint(0, 30))), "deep": {"list": [{"a": "}{"}, {"b": [1, {"c": "]"}]}], "n": n}} for n in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=rng.random() < 0.5), encoding="utf-8")
    (tmp_path / "none.json").write_text(" [ ] ")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert arrays.pieces(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() > 10
        got = p.read_rows(spark, str(tmp_path / "a.json"))
        assert [(r["id"], r["content"], r["deep"]["n"], r["deep"]["list"][0]["a"]) for r in got.orderBy("deep.n").collect()] == [(r["id"], r["content"], r["deep"]["n"], "}{") for r in rows]
        assert {r["id"] for r in p.read_rows(spark, str(tmp_path / "a.json"), limit=3).collect()} == {"0", "1", "2"}
        assert arrays.records(spark, str(tmp_path / "none.json")).count() == 0
        assert [json.loads(r["json"]) for r in arrays.records(spark, str(tmp_path / "a.json")).orderBy("record").collect()] == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "bad.json").write_text('[{"a": 1}, 5, {"a": 2}]')
    with pytest.raises(Exception, match="no object"):
        arrays.records(spark, str(tmp_path / "bad.json")).collect()


def test_coercion_failures(spark):
    df = spark.createDataFrame([("2026-01-02T10:00:00Z", "x"), ("2026-01-02 10:00:00", None), ("soon", "1767348000"), (None, "")], "a string, b string")
    assert {r["column"]: r["failures"] for r in q.coercion_failures(df, ["a", "b"]).collect()} == {"a": 2, "b": 2}


def test_reports_and_the_log(spark, tmp_path):
    posts = make_posts(spark, ("1", "h", None, "2026-01-01T02:00:01Z", "x"))
    sinks.write_report(q.fingerprint(posts), str(tmp_path / "report"))
    sinks.append_raw(posts, str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == spark.read.json(str(tmp_path / "report")).count() == 1
