"""Risk scores kept by blocks of time: a batch of posts reads and writes the blocks it can change, however long the history is.

A block is as wide as scores look back. A post at time t changes scores from t on up to one width later, so those of
its own block and of the next one; what those depend on lies in them and in the block before. Windows begin and end
at instants, so that sums by the minute couldn't replace the posts of their first and last minute: a block keeps the
posts, with their scores.

The table is laid out as tables.py says, with the block for a bucket. A commit names every block that has rows: some
2,200 a year, if a block is four hours.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, Rules, Settings
from ..operators import risk
from ..operators.temporal import MINUTE, bucket, cut
from ..sources import tables

TS = "received_at_utc"
#: The block of posts without a time; such a post has no others before or after it.
UNTIMED = -(2**31)


def block(s: Settings = risk.SETTINGS) -> Column:
    return F.coalesce(bucket(TS, risk.span_minutes(s) * MINUTE).cast("int"), F.lit(UNTIMED))


def changed(blocks: Iterable[int]) -> set[int]:
    """The blocks whose scores posts in these blocks can change."""
    return {b for own in blocks for b in ((own,) if own == UNTIMED else (own, own + 1))}


def needed(blocks: Iterable[int]) -> set[int]:
    """The blocks that the scores of these blocks depend on."""
    return {b for own in blocks for b in ((own,) if own == UNTIMED else (own - 1, own))}


def add(new: DataFrame, path: str, s: Settings = risk.SETTINGS, rules: Rules = DEFAULT_RULES, *, writer: str | None = None, batch: int | None = None) -> bool:
    """Adds classified posts to the table of scores at path (tables.read_table()), and scores anew what they change.

    The table has the columns of the posts and risk.SCORED, as risk.score() without timing features gives them for
    all posts at once, in whatever batches and order they came. Every row is a post, repeated ones too: thin a stream
    out before, with live.newest_seen() for example. Posts without a time are kept and scored by themselves. Columns
    of new that are named as in risk.SCORED are left out. A batch of a writer that is already in is left out: False
    is returned. One writer at a time; settings must stay the same.
    """
    spark = new.sparkSession
    last = tables.last_commit(spark, path, buckets=0)
    if last.has(writer, batch):
        return False
    rows = cut(new.drop(*risk.SCORED))
    own = {r[0] for r in rows.select(block(s)).distinct().collect()}
    written = changed(own)
    old = tables.rows_of(spark, path, last, sorted(needed(written)))
    near = rows if old is None else old.drop(*risk.SCORED).unionByName(rows, allowMissingColumns=True)
    found = risk.score(near, s, rules, timing=False).where(block(s).isin(sorted(written)))
    # a next block without posts gets none
    tables.replace(spark, path, last, found, block(s), sorted(b for b in written if b in own or b in last.versions), writer=writer, batch=batch)
    return True
