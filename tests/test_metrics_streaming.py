import hashlib
import json
import random

import market
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import metrics, quality, signals, study
from tideline.sources import tables
from tideline.sources.posts import normalise_statuses
from tideline.streaming import live

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "created_at", "received_at", "content")])


def status(i, received, text="hello"):
    return {"id": i, "created_at": "2026-01-02T10:00:00Z", "received_at": received, "content": text}


def test_stream_collects_and_keeps_the_newest(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    places = {k: str(tmp_path / k) for k in ("table", "raw_log", "checkpoint")}

    def run(name, rows):
        (folder / name).write_text("\n".join(map(json.dumps, rows)))
        live.collect(live.landed(spark, str(folder), SCHEMA), normalise=normalise_statuses, once=True, **places).awaitTermination()

    run("1.json", [status("a", "2026-01-02T10:00:01Z"), status("b", "2026-01-02T10:00:02Z")])
    run("2.json", [status("a", "2026-01-02T10:00:09Z"), status("a", "2026-01-02T10:00:09Z", "edited")])
    posts = tables.read_table(spark, places["table"])
    assert sorted((r["post_id"], r["text_clean"], r["received_at_utc"].second) for r in posts.collect()) == [("a", "edited", 9), ("a", "hello", 9), ("b", "hello", 2)]
    assert spark.read.json(places["raw_log"]).count() == 4
    fresh = live.health(posts, source="s", checked_at="2026-01-02 10:00:15", raw=spark.read.json(places["raw_log"]).withColumn("id", F.col("post_id")))
    assert (fresh.first()["raw_rows"], fresh.first()["duplicate_rows"], fresh.first()["canonical_rows"], fresh.first()["latest_post_age_seconds"]) == (4, 2, 3, 15)
    none = live.health(posts.where("false"), source="s", checked_at="2026-01-02 10:00:15", errors=1).first()
    assert none["is_stale"] and none["schema_drift"] and none["lag_seconds"] is None
    assert not signals.stale_flag(fresh, ["s"]).first()[0]
    assert signals.stale_flag(live.health(posts, source="s", checked_at="2026-01-02 10:01:15"), ["s"]).first()[0]


def test_a_batch_that_a_new_query_runs_again_changes_nothing(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(map(json.dumps, [status("a", "2026-01-02T10:00:01Z"), status("b", "2026-01-03T10:00:02Z")])))
    places = {k: str(tmp_path / k) for k in ("table", "raw_log", "checkpoint")}

    def run():
        live.collect(live.landed(spark, str(folder), SCHEMA), normalise=normalise_statuses, once=True, **places).awaitTermination()
        return sorted(p.name for p in (tmp_path / "raw_log").glob("day=*/batch=*")), tables.last_commit(spark, places["table"]).number

    first = run()
    # as if the query had died after its writes, before it told the checkpoint of them
    for ended in (tmp_path / "checkpoint" / "commits").iterdir():
        ended.unlink()
    assert run() == first
    assert first == (["batch=" + hashlib.sha256(places["checkpoint"].encode()).hexdigest()[:16] + "-0"] * 2, 1)
    assert sorted(r["post_id"] for r in spark.read.json(places["raw_log"]).collect()) == ["a", "b"]


def test_first_seen_drops_repeats(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"post_id": i, "content_hash": "h", "received_at_utc": t}) for i, t in (("a", "2026-01-02T10:00:00Z"), ("a", "2026-01-02T10:00:05Z"), ("b", "2026-01-02T10:00:01Z"))))
    stream = live.landed(spark, str(folder), T.StructType.fromDDL("post_id string, content_hash string, received_at_utc timestamp"))
    live.first_seen(stream).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["post_id"] for r in spark.table("seen").collect()) == ["a", "b"]


def test_newest_version_replaces_earlier_ones(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []

    def run(name, *rows):
        (folder / name).write_text("\n".join(json.dumps({"post_id": i, "content_hash": "h", "received_at_utc": f"2026-01-02T{t}Z", "text": x}) for i, t, x in rows))
        stream = live.landed(spark, str(folder), T.StructType.fromDDL("post_id string, content_hash string, received_at_utc timestamp, text string"))
        found = []
        query = live.newest_seen(stream, minutes=30).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: found.extend((r["post_id"], r["text"]) for r in df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(sorted(found))

    try:
        run("1.json", ("a", "10:00:00", "first"), ("a", "10:00:05", "second"), ("b", "10:00:01", "only"))
        run("2.json", ("a", "10:00:03", "earlier"), ("b", "10:00:01", "again"), ("b", "10:00:09", "newer"))
        run("3.json", ("c", "12:00:00", "moves the watermark"))
        run("4.json", ("a", "10:10:00", "late"), ("c", "12:00:00", "equal"), ("d", "11:45:00", "in time"))
        run("5.json", ("a", "12:10:00", "after its state went"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen == [[("a", "second"), ("b", "only")], [("b", "newer")], [("c", "moves the watermark")], [("d", "in time")], [("a", "after its state went")]]


def test_a_changed_row_names_its_range(spark):
    df = spark.range(1_000).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("v"), F.lit(None).cast("string").alias("w")).unionByName(spark.createDataFrame([(None, "x", "y"), (5, "t5", None)], "k long, v string, w string"))
    tree = lambda rows: {(r["level"], r["node"]): (r["row_count"], r["digest"]) for r in quality.digest_tree(rows, "k", span=10, fan=4, levels=4).collect()}
    whole = tree(df)
    assert whole == tree(df.repartition(7).select("w", "v", "k")) and whole[4, 0][0] == 1_002
    changed = tree(df.withColumn("v", F.when(F.col("k") == 777, "T").otherwise(F.col("v"))))
    assert {n for n in whole if whole[n] != changed[n]} == {(0, 77), (1, 19), (2, 4), (3, 1), (4, 0)}
    # a value that moves to another column, a repeated row, and null against its mark are changes too
    for other in (df.withColumns({"v": F.col("w"), "w": F.col("v")}), df.unionByName(df.where("k = 9")), df.withColumn("w", F.coalesce("w", F.lit("-")))):
        assert tree(other)[4, 0] != whole[4, 0]
    assert tree(df.where("false")) == {}


def test_exact_quantiles(spark):
    rng = random.Random(3)
    groups = {"all": [rng.choice([1.0, 2.0, 2.0, 3.5]) for _ in range(3_000)] + [7.25], "one": [4.0], "two": [1.0, 2.0], None: [rng.gauss(0, 1) for _ in range(501)], "none": []}
    rows = [(g, x) for g, xs in groups.items() for x in [*xs, None]]
    df = spark.createDataFrame(rows, "label string, v double")
    out = study.target_summary(df, ["v"], ["label"])
    assert "percentile" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        xs = groups[r["label"]]
        want = [round(float(np.quantile(xs, p)), 4) if xs else None for p in (0.1, 0.5, 0.9)]
        assert r["n"] == len(xs) and [r["p10_ticks"], r["median_ticks"], r["p90_ticks"]] == (pytest.approx(want, abs=1e-4) if xs else want)


def test_rescoring_covers_late_posts(spark):
    rows = [("a", "01:00:00", ""), ("b", "06:00:00", ""), ("c", "09:00:00", ""), ("d", "12:59:00", ""), ("e", "13:01:00", "")]
    posts = market.posts(spark, rows)
    again = live.rescore(posts.where("post_id = 'c'"), posts, lambda df: df.withColumn("n", F.lit(1)))
    assert {r["post_id"] for r in again.collect()} == {"c", "d"}
    assert live.lookup(posts.withColumn("event_id", F.lit("e"))).first()["post_id"] == "e"


def test_macro_f1_and_calibration(spark):
    rows = [("a", "a", 0.9), ("a", "b", 0.6), ("b", "b", 1.0), ("c", "b", 0.5)]
    df = spark.createDataFrame(rows, "actual string, predicted string, confidence double")
    assert tuple(metrics.summary_metrics(df).first()) == (4, 0.5, round((2 / 3 + 0.5 + 0) / 3, 6))
    assert metrics.calibration_error(df).first()[0] == round((2 * 0.05 + 0.6 + 0.5) / 4, 6)
    assert metrics.majority(df).first()[0] == "a"
    got = {r["threshold"]: r["n"] for r in metrics.abstention_curve(df).collect()}
    assert got == {0.0: 4, 0.5: 4, 0.6: 3, 0.7: 2, 0.8: 2, 0.9: 2}


def test_keep_latest_and_fingerprint(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert sorted(r["v"] for r in quality.keep_latest(df, ["k"], [F.col("o")]).collect()) == ["b", "c"]
    assert quality.fingerprint(df).first() == quality.fingerprint(df.repartition(3).select("v", "k", "o")).first()
