"""Joins and scans over one long timeline, dealt to tasks by counts, so that a dense hour is spread like any other.

Rows are sorted into ranges of about equal numbers, whose borders Spark samples; ties are broken by a key, so that a
single instant can be cut too. Every scan runs within its range; what a range needs from those before it is one row
for each range (the carry), combined over a table with one row for each range and group. Rows that are scanned hold
keys, times and the values asked for: callers join the rest of a row back by its key.

Rows without a time take no part, however many they are, and come back with nulls in the columns that are added.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

MINUTE = 60_000_000
PART = "_part"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a temporary one; a cluster is an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tideline-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: operators use their input several times, so that plans would double at every step."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, key: str = "_row") -> DataFrame:
    """df with a number of its own for every row, cut off so that it stays the same: ids may be repeated or null."""
    return df if key in df.columns else cut(df.withColumn(key, F.monotonically_increasing_id()))


def timed(df: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a time and those without one."""
    return df.where(F.col(ts).isNotNull()), df.where(F.col(ts).isNull())


def with_untimed(out: DataFrame, rest: DataFrame) -> DataFrame:
    return out.unionByName(rest, allowMissingColumns=True)


def bucket(ts: str | Column, width: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / F.lit(width)).cast("long")


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with _part, the number of the row's range in the given order: ranges have about equal counts and are written once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()))


def _sorted(order: Sequence[str], backward: bool) -> list[Column]:
    return [F.col(c).desc() if backward else F.col(c).asc() for c in order]


def _within(order: Sequence[str], by: Sequence[str], backward: bool = False) -> WindowSpec:
    return Window.partitionBy(*by, PART).orderBy(*_sorted(order, backward))


def _ranges(by: Sequence[str], backward: bool = False) -> WindowSpec:
    """Over the carries: one row for each range and group."""
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(*_sorted([PART], backward))


def _with_carries(rows: DataFrame, carries: DataFrame, by: Sequence[str]) -> DataFrame:
    # without groups there are no more carries than ranges
    return rows.join(carries if by else F.broadcast(carries), [*by, PART], "left")


def running(rows: DataFrame, order: Sequence[str], sums: dict[str, Column], *, by: Sequence[str] = ()) -> DataFrame:
    """Adds running sums to ranged() rows, up to and with the row."""
    upto, before = Window.unboundedPreceding, _ranges(by).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, PART).agg(*(F.sum(v).alias(f"_total_{k}") for k, v in sums.items()))
    carries = totals.select(*by, PART, *(F.sum(f"_total_{k}").over(before).alias(f"_before_{k}") for k in sums))
    here = _within(order, by).rowsBetween(upto, Window.currentRow)
    zero = F.lit(0)
    out = _with_carries(rows.withColumns({f"_here_{k}": F.sum(v).over(here) for k, v in sums.items()}), carries, by)
    return out.withColumns({k: F.coalesce(f"_here_{k}", zero) + F.coalesce(f"_before_{k}", zero) for k in sums}).drop(*(f"_{x}_{k}" for k in sums for x in ("here", "before")))


def running_max(rows: DataFrame, order: Sequence[str], column: str, name: str) -> DataFrame:
    """Adds the running maximum of a column to ranged() rows."""
    before = _ranges(()).rowsBetween(Window.unboundedPreceding, -1)
    carries = rows.groupBy(PART).agg(F.max(column).alias("_high")).select(PART, F.max("_high").over(before).alias("_before"))
    here = _within(order, ()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_carries(rows.withColumn(name, F.max(column).over(here)), carries, ()).withColumn(name, F.greatest(name, "_before")).drop("_before")


def filled(rows: DataFrame, order: Sequence[str], columns: dict[str, Column], *, by: Sequence[str] = (), backward: bool = False) -> DataFrame:
    """Adds to ranged() rows the last non-null value of each column up to and with the row; backward: the first from the row on.

    Going backward is a scan in descending order: a frame that reaches forward would be summed anew for every row.
    """
    rows = rows.withColumns({f"_value_{k}": v for k, v in columns.items()})
    at, pick = F.struct(*order), F.min_by if backward else F.max_by
    ends = rows.groupBy(*by, PART).agg(*(pick(f"_value_{k}", F.when(F.col(f"_value_{k}").isNotNull(), at)).alias(f"_end_{k}") for k in columns))
    before = _ranges(by, backward).rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.select(*by, PART, *(F.last(f"_end_{k}", ignorenulls=True).over(before).alias(f"_before_{k}") for k in columns))
    here = _within(order, by, backward).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _with_carries(rows.withColumns({f"_here_{k}": F.last(f"_value_{k}", ignorenulls=True).over(here) for k in columns}), carries, by)
    return out.withColumns({k: F.coalesce(f"_here_{k}", f"_before_{k}") for k in columns}).drop(*(f"_{x}_{k}" for k in columns for x in ("here", "before", "value")))


def shifted(rows: DataFrame, order: Sequence[str], columns: dict[str, Column], *, backward: bool = False) -> DataFrame:
    """Adds to ranged() rows each column's value of the row before; backward: of the row after."""
    boxed = {k: F.struct(v.alias("v")) for k, v in columns.items()}
    at, pick = F.struct(*order), F.min_by if backward else F.max_by
    ends = rows.groupBy(PART).agg(*(pick(v, at).alias(f"_end_{k}") for k, v in boxed.items()))
    carries = ends.select(PART, *(F.lag(f"_end_{k}").over(_ranges((), backward)).alias(f"_before_{k}") for k in columns))
    out = _with_carries(rows.withColumns({f"_here_{k}": F.lag(v).over(_within(order, (), backward)) for k, v in boxed.items()}), carries, ())
    return out.withColumns({k: F.coalesce(f"_here_{k}", f"_before_{k}")["v"] for k in columns}).drop(*(f"_{x}_{k}" for k in columns for x in ("here", "before")))


def first_after(probes: DataFrame, points: DataFrame, *, keys: Sequence[str], at: str, point_at: str, tie: str | None = None, by: Sequence[str] = (), name: str = "match") -> DataFrame:
    """Columns `keys` and a struct `name`: the first point whose point_at is at or after a probe's `at` (null where none follows).

    at and point_at are of one type that has an order; equal values match. Of points with equal values the one with
    the smallest `tie` (a whole number) is taken, or any. `by` columns, not null, are in both and must be equal. keys
    tell probes apart; where they don't, both rows get the same match.
    """
    p = probes.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.xxhash64(*keys).alias("_tie"), F.struct(*keys).alias("_key"))
    q = points.where(F.col(point_at).isNotNull())
    q = q.select(*by, F.col(point_at).alias("_at"), F.lit(1).alias("_side"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("_tie"), F.struct(*[c for c in points.columns if c not in by]).alias("_point"))
    order = ["_at", "_side", "_tie"]
    rows = ranged(p.unionByName(q, allowMissingColumns=True), [*by, *order])
    return filled(rows, order, {name: F.col("_point")}, by=by, backward=True).where("_side = 0").select("_key.*", name)


def forward_asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, *, by: list[str] | None = None, name: str = "match") -> DataFrame:
    """left with a struct `name` of the first right row at or after left_ts (null where none follows).

    Equal times match. Of right rows with equal times, any one is taken: keep them distinct. Only keys and times of
    left are sorted; its other columns are joined back.
    """
    left = keyed(left, "_asof")
    found = first_after(left, right, keys=["_asof"], at=left_ts, point_at=right_ts, by=by or (), name=name)
    return left.join(found, "_asof", "left").drop("_asof")


def sums_before(df: DataFrame, ts: str, key: str, minutes: Sequence[int], sums: dict[str, Column]) -> DataFrame:
    """key and a column {name}_{m} for each of `sums` and minutes m: whole numbers summed over the rows of the last m minutes, the row's own instant excluded.

    A sum between two instants is the difference of two running sums: every row asks for that before its own instant
    and before the start of each span.
    """
    asks = F.array(F.struct(F.lit(-1).alias("m")), *(F.struct(F.lit(m).alias("m")) for m in (0, *minutes)))
    names = list(sums)
    rows = timed(df, ts)[0].select(F.col(key).alias("_key"), F.unix_micros(ts).alias("_t"), *(v.cast("long").alias(f"_v_{k}") for k, v in sums.items()))
    rows = rows.select("*", F.explode(asks).alias("_ask")).select("_key", F.col("_ask.m").alias("_m"), (F.col("_t") - F.when(F.col("_ask.m") > 0, F.col("_ask.m").cast("long") * MINUTE).otherwise(0)).alias("_t"), *(F.when(F.col("_ask.m") < 0, F.col(f"_v_{k}")).alias(f"_v_{k}") for k in names))
    # at one instant the questions come before the rows, so that those aren't counted
    rows = ranged(rows.withColumn("_side", (F.col("_m") < 0).cast("int")), ["_t", "_side", "_key"])
    counted = running(rows, ["_t", "_side"], {k: F.col(f"_v_{k}") for k in names}).where("_side = 0")
    return counted.groupBy(F.col("_key").alias(key)).agg(*((F.max(F.when(F.col("_m") == 0, F.col(k))) - F.max(F.when(F.col("_m") == m, F.col(k)))).alias(f"{k}_{m}") for k in names for m in minutes))


def neighbours(rows: DataFrame, order: Sequence[str], ts: str) -> DataFrame:
    """Adds previous_ts and next_ts to ranged() rows: the time of the row before and after."""
    return shifted(shifted(rows, order, {"previous_ts": F.col(ts)}), order, {"next_ts": F.col(ts)}, backward=True)
