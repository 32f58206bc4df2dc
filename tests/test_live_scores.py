import json
import random
from datetime import timedelta

import market
import pytest
from pyspark.sql import functions as F

from tideline.functions.rules import classify
from tideline.operators import risk
from tideline.sources import tables
from tideline.streaming import live, scores

@pytest.fixture(autouse=True)
def few_ranges(spark):
    """Scans write once for each range: two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


TEXTS = ["Steel tariff now", "A deal will come, growth!", "Oil from Iran", "thank you", ""]
SCHEMA = "post_id string, received_at_utc timestamp, created_at_utc timestamp, text_clean string"


def made(n, seed, hours):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = market.OPENING + timedelta(minutes=rng.choice([0, 60, 240, rng.randrange(hours * 60)]), microseconds=rng.choice([0, 0, 1]))
        rows.append((f"p{i % (n - 3)}", None if i % 25 == 7 else t, t, rng.choice(TEXTS)))
    return rows


def as_rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.select("post_id", "received_at_utc", "text_clean", *risk.SCORED).collect())


def test_ten_batches_give_what_all_posts_at_once_give(spark, tmp_path):
    path, rows = str(tmp_path / "scores"), made(120, 5, 40)
    posts = classify(spark.createDataFrame(rows, SCHEMA))
    whole = as_rows(risk.score(posts, timing=False))
    random.Random(6).shuffle(rows)
    for k in range(10):
        # a clashing name and a column that comes later
        batch = classify(spark.createDataFrame(rows[k::10], SCHEMA)).withColumn("whipsaw_score", F.lit("x"))
        batch = batch.withColumn("extra", F.lit(k)) if k > 4 else batch
        assert scores.add(batch, path, writer="w", batch=k)
    assert as_rows(tables.read_table(spark, path)) == whole
    before = tables.last_commit(spark, path)
    assert not scores.add(posts, path, writer="w", batch=9) and tables.last_commit(spark, path) == before
    # a run that died before its commit leaves files that the next one writes over
    posts.write.partitionBy("post_id").parquet(f"{path}/data/v={before.number + 1}")
    scores.add(posts.where("false"), path, writer="w", batch=10)
    assert as_rows(tables.read_table(spark, path)) == whole


def test_a_batch_reads_and_writes_near_blocks_only(spark, tmp_path):
    path = str(tmp_path / "scores")
    day = [(f"{i}", market.OPENING + timedelta(hours=i), None, "tariff") for i in range(240)]
    scores.add(classify(spark.createDataFrame(day, SCHEMA)), path)
    first = tables.last_commit(spark, path)
    late = [("late", market.OPENING + timedelta(hours=100, minutes=30), None, "deal"), ("untimed", None, None, "deal")]
    scores.add(classify(spark.createDataFrame(late, SCHEMA)), path)
    second = tables.last_commit(spark, path)
    own = int((late[0][1] - market.datetime(1970, 1, 1)).total_seconds() // (240 * 60))
    assert {b for b, v in second.versions.items() if v == second.number} == {own, own + 1, scores.UNTIMED} == scores.changed({own, scores.UNTIMED})
    read = tables.rows_of(spark, path, first, sorted(scores.needed(scores.changed({own, scores.UNTIMED}))))
    assert read.count() == 12 and {int(f.split("_bucket=")[1].split("/")[0]) for f in read.inputFiles()} == {own - 1, own, own + 1}
    everything = classify(spark.createDataFrame([*day, *late], SCHEMA))
    assert as_rows(tables.read_table(spark, path)) == as_rows(risk.score(everything, timing=False))


def test_a_stream_of_posts_is_scored(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "scores")
    rows = classify(spark.createDataFrame(made(30, 7, 6), SCHEMA))
    rows.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    for _ in range(2):  # the second run finds nothing new
        live.score_posts(stream, table=path, checkpoint=str(tmp_path / "state"), once=True).awaitTermination()
    assert as_rows(tables.read_table(spark, path)) == as_rows(risk.score(rows, timing=False))
    assert tables.last_commit(spark, path).number == 2


def test_no_posts_at_all(spark, tmp_path):
    path = str(tmp_path / "scores")
    scores.add(classify(spark.createDataFrame([], SCHEMA)), path)
    found = tables.read_table(spark, path)
    assert found.count() == 0 and set(risk.SCORED) <= set(found.columns)
