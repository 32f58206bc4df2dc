"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_BITS = 33
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4_000_000


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a temporary one; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tideline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; its content is needed until the query that uses it has ended."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later steps don't depend on the executors that made it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a number of its own for every row, for matched(), as a table in the shared folder."""
    return materialised(df.withColumn(column, F.monotonically_increasing_id()), name)


def matched(rows: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """Rows of a numbered() table whose number is in side (each once), with side's other columns: a join that leaves rows where they are.

    Numbers have the partition they were given in in their upper bits. side is written to the shared folder by
    that partition, and a task reads what belongs to the partitions it meets, so that no text crosses an exchange.
    """
    spark = rows.sparkSession
    path = scratch(spark, "side")
    side = side.withColumn("_part", F.shiftright(column, PART_BITS))
    side.repartition(parallelism(spark), "_part").write.partitionBy("_part").parquet(path)
    others = [c for c in side.columns if c not in (column, "_part")]
    at, schema = rows.columns.index(column), T.StructType([*rows.schema, *(side.schema[c] for c in others)])
    names = schema.names

    def of(fs: FileSystem, base: str, part: int) -> tuple[np.ndarray, pa.Table]:
        found = []
        for info in fs.get_file_info(FileSelector(f"{base}/_part={part}", allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    found.append(pq.read_table(f, columns=[column, *others]))
        if not found:
            return np.zeros(0, np.int64), pa.table({})
        table = pa.concat_tables(found).sort_by(column).combine_chunks()
        return table.column(column).to_numpy(), table

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, base), part, known, table = FileSystem.from_uri(path), None, None, None
        for batch in batches:
            numbers = batch.column(at).to_numpy()
            parts = numbers >> PART_BITS
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else []
            for start, stop in itertools.pairwise(edges):
                if parts[start] != part:
                    part = int(parts[start])
                    known, table = of(fs, base, part)
                if not len(known):
                    continue
                own = numbers[start:stop]
                place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                hit = known[place] == own
                if hit.any():
                    kept, beside = batch.slice(start, stop - start).filter(pa.array(hit)), table.take(pa.array(place[hit])).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*kept.columns, *(beside.column(c).combine_chunks() for c in others)], names=names)

    return rows.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python of BATCH_BYTES at most (or one row) in this session, unless it has set a limit itself.

    Spark's own limits are 10,000 rows and 64 MB. For whole texts its buffers, which are off the heap and double as they
    grow, are several times a batch for each task, and what executors once took there they keep. Spark reads the limit
    when it runs a plan, so it has to stay set after a stage has been planned. No result depends on it.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions that the deployment has set for its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes in column `text`, or one row if that has more."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def packed(carry: list[str]) -> Column:
    """Columns that an operator passes on as they are, as one struct, so that no name of theirs can clash."""
    return F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.lit(0).alias("none"))


def unpacked(carry: list[str], column: str = "rest") -> list[Column]:
    return [F.col(f"{column}.c{i}").alias(c) for i, c in enumerate(carry)]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df hasn't yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which its worker gives memory back: workers are reused, and several share an executor's limit."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # only glibc has it

    return inner
