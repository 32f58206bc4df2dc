"""Exact top-k inner products with the threshold algorithm.

Each block of candidates keeps one list per dimension, sorted by value. For a query all lists are walked
together, from the end that its sign favours; rows met for the first time are scored in full. No row below
the current depth can score more than the sum of the values at that depth, times the query: once that bound is
under the kth best score, the block is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import released, scratch

BLOCK_ROWS = 8_192
QUERY_BLOCK = 2_048
FIRST_DEPTH = 8


def quantised(vector_col: str, scale: int = 1024):
    """floor(scale * x) of each component as longs; null for vectors that are null or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(F.lit(scale) * x).cast("long")))


class SortedLists:
    """A block of candidates of one length with its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.largest = float(np.abs(vectors.astype(float)).max(initial=0))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products; beyond whole doubles with numbers of any size."""
        if self.largest * float(np.abs(query.astype(float)).max(initial=0)) * max(1, len(query)) < 2**53:
            return (self.vectors[rows].astype(float) @ query.astype(float)).astype(np.int64)
        out = [sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in self.vectors[rows]]
        return np.array(out, np.int64)

    def best(self, own: int, query: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of this block and of those given, best first and smaller ids first among equals."""
        n, used = len(self.ids), np.flatnonzero(query)
        up = query[used] < 0
        fresh, depth = np.ones(n, bool), 0
        while depth < n:
            deeper = min(n, 2 * depth + FIRST_DEPTH if len(used) else n)
            if len(used):
                rows = np.concatenate([self.order[depth:deeper][:, used[up]].ravel(), self.order[n - deeper : n - depth][:, used[~up]].ravel()])
                met = np.zeros(n, bool)
                met[rows] = True
                rows = np.flatnonzero(met & fresh)
                fresh[rows] = False
            else:
                rows = np.arange(n)
            depth = deeper
            rows = rows[self.ids[rows] != own]
            scores, ids = np.r_[scores, self.scores(rows, query)], np.r_[ids, self.ids[rows]]
            keep = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[keep], ids[keep]
            if len(used) and depth < n and len(scores) == k:
                edge = np.where(up, self.order[depth - 1, used], self.order[n - depth, used])
                bound = sum(int(a) * int(b) for a, b in zip(self.vectors[edge, used], query[used], strict=True))
                if bound < scores[-1]:
                    break
        return scores, ids


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k candidates with the highest inner product for every query.

    Vectors are taken as floor(scale * component). Returns query_id, rank (from 1), vec_id and score (long); ties go
    to the smaller id, a query without k candidates gets all. Rows with the query's own id are no candidates of
    it; rows with a null id, and vectors that are null or hold null or non-finite components, take no part;
    only vectors of equal length are compared. Repeated query ids ask once, with the smallest vector; repeated
    candidates each count. Other columns are ignored; an empty table gives no rows. Queries are a table in the
    shared folder, which tasks read in blocks of query_block; a task sorts the lists of its candidates once.
    Components and scores beyond 64 bits are an error.
    """
    v = F.col(vector_col).cast("array<double>")
    huge = F.exists(v, lambda x: (F.abs(x) < F.lit(float("inf"))) & (F.abs(x * scale) >= F.lit(2.0**63)))
    checked = F.when(~F.coalesce(huge, F.lit(False)), quantised(vector_col, scale)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("array<bigint>"))
    prepared = lambda df: df.select(F.col(id_col).cast("long").alias("id"), checked.alias("v")).where("id is not null and v is not null")
    asked = prepared(queries).groupBy("id").agg(F.min("v").alias("v"))
    path = scratch(queries.sparkSession, "top-k-queries")
    asked.write.parquet(path)
    found = prepared(candidates).mapInArrow(_search(path, k, query_block), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By vector length: ids and vectors."""
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        yield width, ids[rows], flat[starts[rows][:, None] + np.arange(width)].reshape(len(rows), width)


def _search(path: str, k: int, query_block: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for width, ids, vectors in _rows(batch):
                held.setdefault(width, []).append((ids, vectors))
        lists: dict[int, list[SortedLists]] = {}
        for width, parts in held.items():
            ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
            lists[width] = [SortedLists(ids[at : at + BLOCK_ROWS], vectors[at : at + BLOCK_ROWS]) for at in range(0, len(ids), BLOCK_ROWS)]
        held.clear()
        if not lists:
            return
        fs, base = FileSystem.from_uri(path)
        none = np.zeros(0, np.int64)
        for info in sorted(fs.get_file_info(FileSelector(base)), key=lambda x: x.path):
            if not info.path.endswith(".parquet"):
                continue
            with fs.open_input_file(info.path) as f:
                for block in pq.ParquetFile(f).iter_batches(query_block, columns=["id", "v"]):
                    found: list[tuple[np.ndarray, ...]] = [(none, none, none)]
                    for width, ids, vectors in _rows(block):
                        for q, vector in zip(ids.tolist(), vectors, strict=True):
                            scores, best = none, none
                            for part in lists.get(width, ()):
                                scores, best = part.best(q, vector, k, scores, best)
                            found.append((np.full(len(best), q), best, scores))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    return run
