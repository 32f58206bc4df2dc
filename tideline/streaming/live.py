"""Continuous collection of landed rows, scoring of what they touch, and the latest signal."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import DEFAULT_RULES, Rules, Settings
from ..operators.quality import keep_latest
from ..operators.risk import SETTINGS
from ..operators.temporal import cut
from ..sources.sinks import append_raw
from ..sources.tables import upsert
from . import scores

LOOKBACK_MINUTES = 240


def landed(spark: SparkSession, path: str, schema: T.StructType, *, max_files: int = 1_000) -> DataFrame:
    """A stream of JSON rows that land as files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def first_seen(stream: DataFrame, ts: str = "received_at_utc", minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    """Drops repeats of (post_id, content_hash) within the watermark. It keeps the first, so it only thins a stream out before upsert(); newest_seen() keeps the newest."""
    return stream.withWatermark(ts, f"{minutes} minutes").dropDuplicatesWithinWatermark(["post_id", "content_hash"])


class Newest(StatefulProcessor):
    """Of a key's versions the one with the latest receipt, for as long as the watermark is less than `minutes` behind it.

    The state is that receipt (in microseconds). A later version is passed on and replaces it; an equal or earlier one
    is not. When the watermark passes the receipt by `minutes`, a timer clears the state.
    """

    def __init__(self, ts: str, minutes: int) -> None:
        self.ts, self.minutes = ts, minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, found = (self.best.get()[0] if self.best.exists() else None), None
        for frame in rows:
            frame = frame[frame[self.ts].notna()]
            if len(frame):
                top = frame.loc[[frame[self.ts].idxmax()]]
                if found is None or top[self.ts].iloc[0] > found[self.ts].iloc[0]:
                    found = top
        if found is None:
            return
        micros = found[self.ts].iloc[0].value // 1000
        if known is None or micros > known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.best.update((micros,))
            self.handle.registerTimer(micros // 1000 + self.minutes * 60_000)
            yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.best.clear()
        return iter([])

    def close(self) -> None:
        pass


def newest_seen(stream: DataFrame, ts: str = "received_at_utc", *, keys: tuple[str, ...] = ("post_id", "content_hash"), minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    """A stream in update mode of each key's newest version: a later one follows and replaces what was passed on before.

    Rows more than `minutes` behind the latest are late and left out, as are rows without a time. The state, one number
    for each key of the last `minutes`, is kept by RocksDB: set spark.sql.streaming.stateStore.providerClass to it.
    """
    rows = stream.withWatermark(ts, f"{minutes} minutes")
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=Newest(ts, minutes), outputStructType=stream.schema, outputMode="Update", timeMode="EventTime")


def collect(stream: DataFrame, *, table: str, raw_log: str, checkpoint: str, normalise: Callable[[DataFrame], DataFrame], seconds: int = 5, once: bool = False) -> StreamingQuery:
    """Writes each batch to the raw log by day and merges its normalised posts into the canonical table (tables.read_table()).

    Spark may run a batch again, with its number: the log's lines of that batch are then replaced, and a batch that
    the table has committed is left out, wherever the first run ended. A number counts for one checkpoint folder only.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, number: int) -> None:
        posts = cut(normalise(rows))
        append_raw(posts.select("post_id", "received_at_utc", "raw_json"), raw_log, batch=f"{writer}-{number}")
        upsert(posts, table, writer=writer, batch=number)

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{seconds} seconds")).start()


def health(posts: DataFrame, *, source: str, checked_at: str, stale_seconds: int = 10, collected: bool = True, authorised: bool = True, raw: DataFrame | None = None, id_col: str = "id", errors: int = 0) -> DataFrame:
    """One row for signals.stale_flag(): lag beyond the limit, a failed collection or a bad login is stale; without posts the lag is null.

    Also the age of the newest post, raw rows and repeats among their ids (where raw is given), and drift: errors
    and not one post.
    """
    now = F.unix_timestamp(F.lit(checked_at).cast("timestamp"))
    lag = now - F.unix_timestamp(F.max("received_at_utc"))
    stale = F.coalesce(lag > stale_seconds, F.lit(False)) | F.lit(not collected) | F.lit(not authorised)
    row = posts.agg(lag.alias("lag_seconds"), (now - F.unix_timestamp(F.max("created_at_utc"))).alias("latest_post_age_seconds"), F.count("*").alias("canonical_rows"), (stale | (F.count("*") == 0)).alias("is_stale"))
    seen = raw.agg(F.count("*").alias("raw_rows"), (F.count(id_col) - F.count_distinct(id_col)).alias("duplicate_rows")) if raw is not None else posts.sparkSession.range(1).select(F.lit(None).cast("long").alias("raw_rows"), F.lit(None).cast("long").alias("duplicate_rows"))
    row = row.withColumn("_one", F.lit(1)).join(seen.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return row.select(F.lit(source).alias("source"), "*", F.lit(collected and authorised).alias("is_healthy"), ((F.lit(errors) > 0) & (F.col("canonical_rows") == 0)).alias("schema_drift"))


def score_posts(stream: DataFrame, *, table: str, checkpoint: str, settings: Settings = SETTINGS, rules: Rules = DEFAULT_RULES, seconds: int = 5, once: bool = False) -> StreamingQuery:
    """Adds each batch of classified posts to a table of scores (scores.add()); a batch that is run again changes nothing."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, number: int) -> None:
        scores.add(rows, table, settings, rules, writer=name, batch=number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def rescore(new: DataFrame, posts: DataFrame, score: Callable[[DataFrame], DataFrame], *, minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    """Scores of all posts that new ones can change: from the earliest new post to `minutes` after the latest, with as much history before."""
    span = new.agg(F.min("received_at_utc").alias("_a"), F.max("received_at_utc").alias("_b"))
    micros, width = F.unix_micros("received_at_utc"), minutes * 60_000_000
    near = posts.crossJoin(F.broadcast(span)).where(micros.between(F.unix_micros("_a") - width, F.unix_micros("_b") + width))
    return score(near.drop("_a", "_b")).crossJoin(F.broadcast(span)).where(micros.between(F.unix_micros("_a"), F.unix_micros("_b") + width)).drop("_a", "_b")


def lookup(signals: DataFrame, event_ids: list[str] | None = None) -> DataFrame:
    """The newest signal per event id, for all or some ids."""
    rows = signals if event_ids is None else signals.where(F.col("event_id").isin(*event_ids))
    return keep_latest(rows, ["event_id"], [F.col("received_at_utc")])
