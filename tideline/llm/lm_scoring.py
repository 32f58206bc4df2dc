"""Language-model scores of documents by stupid backoff over n-gram counts of the whole corpus.

Count tables are partitioned by the n-grams' hashes. Tasks explode their documents into n-grams and send each
distinct one of a batch, with its count, to the partition of its hash; there all batches' counts are joined
and summed, and every batch gets the totals of its own n-grams back. Scores are summed per document. A document
is scored by the counts of all others: its own occurrences are taken off.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import parallelism, released, scratch

ORDER = 2
BACKOFF = 0.4
BATCH_BYTES = 16_000_000
ONE_GROUP = 2_000_000_000
TOTALS, WORDS = 0, 1
BASE = np.uint64(0xD6E8FEB86659FD95)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD95, -1, 1 << 64))
_LETTER = np.array([i not in (9, 10, 11, 12, 13, 32) for i in range(256)])


class _Powers:
    up = down = np.ones(1, np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a whole text: A-Z lower-cased, cut at ASCII white space."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8) if text else np.zeros(0, np.uint8)
    letter = np.r_[False, _LETTER[data], False]
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, stop = edge[::2], edge[1::2]
    if len(_Powers.up) <= len(data):
        n = 2 * len(data)
        _Powers.up, _Powers.down = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)]), np.cumprod(np.r_[np.uint64(1), np.full(n, INVERSE)])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _Powers.up[: len(data)], out=sums[1:])
    return _mixed((sums[stop] - sums[start]) * _Powers.down[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Batch:
    """The n-grams of some documents: by order, distinct hashes, their counts, and each n-gram's number and document."""

    def __init__(self, texts: list[str | None], order: int):
        hashes = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        words = np.concatenate(hashes)
        doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.levels = []
        gram = words
        for n in range(1, order + 1):
            if n > 1:
                # of the n-gram that ends here: the shorter one before it and this word
                gram = _mixed(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :]) if len(words) >= n else words[:0]
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            distinct, number, count = np.unique(gram[inside], return_inverse=True, return_counts=True)
            self.levels.append((distinct, count, number, np.flatnonzero(inside) + n - 1, doc[n - 1 :][inside]))

    def scores(self, totals: list[np.ndarray], words: int, backoff: float) -> np.ndarray:
        """Sum of log scores of each document."""
        n = int(self.sizes.sum())
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        others = np.maximum(words - self.sizes, 1)[doc]
        score = shorter = None
        for level, ((_, _, number, at, own), total) in enumerate(zip(self.levels, totals, strict=True)):
            pair = number.astype(np.int64) * len(self.sizes) + own
            _, inverse, mine = np.unique(pair, return_inverse=True, return_counts=True)
            count = np.zeros(n)
            count[at] = total[number] - mine[inverse]
            if level == 0:
                score = np.maximum(count, 1) / others
            else:
                context = np.ones(n)
                context[1:] = shorter[:-1]
                seen = np.zeros(n, bool)
                seen[at] = count[at] > 0
                later = np.zeros(n, bool)
                later[at] = True
                score = np.where(seen, count / np.maximum(context, 1), np.where(later, backoff * score, score))
            shorter = count
        return np.bincount(doc, weights=np.log(score), minlength=len(self.sizes))


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """Score of every text by the n-gram counts of all other rows.

    A word's score is the share of its context's occurrences that it follows; where it never does, `backoff` times its
    score after the context without the first word, and in the end its share of all words (a word no other row
    has counts as one). Returns id_col, n_words, log_score (sum of natural logs) and mean_log_score (null without
    words), a row for each input row. Null texts have no words and score 0. Ids may be null or repeated, repeated
    rows count each other; other columns are ignored; an empty table gives no rows. No n-gram is dropped: counts
    are of 64-bit hashes of all n-grams of all rows.
    """
    spark, n = df.sparkSession, parallelism(df.sparkSession)
    home = scratch(spark, "lm-scores")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kind = df.schema[id_col].dataType
    docs = df.select(F.spark_partition_id().alias("part"), row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # one row group for each file: whatever the sizes of splits, a file is read by one task, and all passes cut the same batches
    docs.write.options(**{"compression": "zstd", "parquet.block.size": ONE_GROUP}).parquet(f"{home}/docs")
    docs = spark.read.schema(docs.schema).parquet(f"{home}/docs")
    blobs = "pid int, part int, batch long, kind int, n long, data binary"
    sent = docs.select("part", "row", "text").mapInArrow(_explode(order, n), blobs).repartition(n, "pid")
    totals = sent.mapInArrow(_count, blobs).repartition(n, "part")
    totals.write.partitionBy("part").parquet(f"{home}/totals")
    words = spark.read.schema("kind int, n long, part int").parquet(f"{home}/totals").where(F.col("kind") == WORDS).agg(F.sum("n")).first()[0] or 0
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType())])
    out = docs.mapInArrow(_sum(f"{home}/totals", order, words, backoff, to_arrow_type(kind)), schema)
    return out.select(F.col("id").alias(id_col), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """part, first row and rows of runs of rows of one part with BATCH_BYTES or a little more."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.column(batch.num_columns - 1), strict=True):
            if held and (row[0] != held[0][0] or size >= BATCH_BYTES):
                yield held[0][0], held[0][1], held
                held, size = [], 0
            held.append((*row[:-1], row[-1].as_py()))
            size += len(held[-1][-1] or "")
    if held:
        yield held[0][0], held[0][1], held


def _cuts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where sorted hashes go from one of n equal ranges to the next."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.r_[0, np.searchsorted(hashes, edges), len(hashes)]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the differences of sorted hashes, first bytes first: leading zeros compress."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _joined(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pid", "part", "batch", "kind", "n", "data"])


def _explode(order: int, n: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first, rows in _batches(batches):
            levels = [(d, c, _cuts(d, n)) for d, c, *_ in Batch([r[-1] for r in rows], order).levels]
            yield _record([(p, part, first, TOTALS, 0, pickle.dumps([(_planes(d[k[p] : k[p + 1]]), _narrow(c[k[p] : k[p + 1]])) for d, c, k in levels])) for p in range(n)])

    return run


@released
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, levels = [], []
    for batch in batches:
        for row in batch.to_pylist():
            keys.append((row["pid"], row["part"], row["batch"]))
            levels.append([(_joined(h), c) for h, c in pickle.loads(row["data"])])
    if not keys:
        return
    totals: list[list[np.ndarray]] = [[] for _ in keys]
    words = 0
    for level in range(len(levels[0])):
        hashes = np.concatenate([x[level][0] for x in levels])
        counts = np.concatenate([x[level][1].astype(np.int64) for x in levels])
        if level == 0:
            words = int(counts.sum())
        _, number = np.unique(hashes, return_inverse=True)
        total = np.bincount(number, weights=counts).astype(np.int64)[number]
        for out, x in zip(totals, np.split(total, np.cumsum([len(x[level][0]) for x in levels])[:-1]), strict=True):
            out.append(_narrow(x))
    yield _record([(pid, part, batch, TOTALS, 0, pickle.dumps(x)) for (pid, part, batch), x in zip(keys, totals, strict=True)])
    yield _record([(0, 0, 0, WORDS, words, None)])


def _sum(path: str, order: int, words: int, backoff: float, id_type: pa.DataType):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(path)
        for part, first, rows in _batches(batches):
            found = []
            for info in fs.get_file_info(FileSelector(f"{base}/part={part}")):
                if info.path.endswith(".parquet"):
                    with fs.open_input_file(info.path) as f:
                        own = pq.read_table(f, columns=["pid", "batch", "kind", "data"], filters=[("batch", "=", first), ("kind", "=", TOTALS)])
                        found += [(r["pid"], pickle.loads(r["data"])) for r in own.to_pylist()]
            found.sort(key=lambda x: x[0])
            batch = Batch([r[-1] for r in rows], order)
            totals = [np.concatenate([x[level].astype(np.int64) for _, x in found]) for level in range(order)]
            if [len(t) for t in totals] != [len(x[0]) for x in batch.levels]:
                raise RuntimeError(f"part {part}, row {first}: totals are of other n-grams than the batch has")
            sums = batch.scores(totals, words, backoff)
            yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], id_type), pa.array(batch.sizes), pa.array(sums)], names=["id", "n_words", "log_score"])

    return run
