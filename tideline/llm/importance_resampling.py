"""Importance resampling: draws documents whose hashed n-grams look like those of a target corpus."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import chunks, materialised, packed, parallelism, released, unpacked

#: bytes of text that are joined for one pass of the pattern
PIECE_BYTES = 1 << 20
#: in UTF-8 every byte of a character beyond ASCII is 0x80 or more, so that bytes can be matched
WORD, BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
SENTINEL = b"\n"


def joined(texts: list[bytes], limit: int) -> Iterator[tuple[bytes, np.ndarray, int, bool]]:
    """Lower-cased texts in one string, with a sentinel between them that no word has, and each text's offset.

    Yields (string, offsets, number of the first text, whether it goes on in the next). A text beyond the limit is cut at the first byte outside a word.
    """
    if sum(map(len, texts)) <= limit:
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        yield SENTINEL.join(texts).lower(), offsets, 0, False
        return
    for number, text in enumerate(map(bytes.lower, texts)):
        start = 0
        while True:
            found = BREAK.search(text, start + limit)
            stop = found.start() if found else len(text)
            yield text[start:stop], np.zeros(1, np.int64), number, stop < len(text)
            if stop == len(text):
                break
            start = stop


def features(texts: list[bytes], *, orders: int, buckets: int, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each joined string and order: the text and the bucket of every n-gram, and the order.

    One pass of the pattern finds the words of all texts; the offset that a word's start falls after names its text,
    and n-grams whose first and last word differ in it are masked. The CRC of an n-gram goes on from that of its first words.
    """
    tail: list[bytes] = []
    for string, offsets, first, goes_on in joined(texts, limit or PIECE_BYTES):
        spans = [m.span() for m in WORD.finditer(string)]
        starts = np.fromiter((a for a, _ in spans), np.int64, len(spans))
        words, old = tail + [string[a:b] for a, b in spans], len(tail)
        owner = np.searchsorted(offsets, starts, side="right") - 1 + first
        if old:
            owner = np.concatenate([np.full(old, first), owner])
        spaced, crcs = [b" " + w for w in words], list(map(zlib.crc32, words))
        for n in range(1, orders + 1):
            if n > 1:
                crcs = list(map(zlib.crc32, spaced[n - 1 :], crcs))
            whole = owner[: len(crcs)] == owner[n - 1 :][: len(crcs)]
            whole[: max(0, old - n + 1)] = False  # those were counted with the string before
            yield owner[: len(crcs)][whole], (np.array(crcs, np.int64) % buckets)[whole], n
        tail = words[-(orders - 1) :] if goes_on and orders > 1 else []


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def bucket_counts(docs: DataFrame, *, text: str = "text", orders: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many n-grams of all texts fall in each bucket; the result has `buckets` numbers, however many rows there are."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in chunks(batches, 0, PIECE_BYTES):
            for _, found, _ in features(_texts(batch.column(0)), orders=orders, buckets=buckets):
                counts += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both distributions in each bucket, one added to every count, rounded down."""
    s, t, size = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * float(s + size) / ((a + 1) * float(t + size)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, key: object) -> int:
    """Thousandths of a Gumbel variable that seed and key decide, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, *, text: str = "text", id_col: str = "doc_id", orders: int = 2, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """Columns `carry`, id, n_words, n_features, weight (floored mean gain of the text's n-grams) and score (weight and noise)."""
    carry = [id_col] if carry is None else carry
    rows = docs.select(packed(carry).alias("rest"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["rest"], rows.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2, PIECE_BYTES):
            words, number, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for owner, found, n in features(_texts(batch.column(2)), orders=orders, buckets=len(gain)):
                counted = np.bincount(owner, minlength=batch.num_rows)
                number += counted
                if n == 1:
                    words += counted
                # sums of whole numbers below 2**53 are exact in doubles
                total += np.bincount(owner, weights=gain[found], minlength=batch.num_rows).astype(np.int64)
            weight = total // np.maximum(number, 1)
            score = weight + np.array([noise(seed, k) for k in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (words, number, weight, score))], names=schema.names)

    return rows.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, min_words: int = 20, text: str = "text", id_col: str = "doc_id", orders: int = 2, buckets: int = 10_000, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """Columns `carry` (default: id_col), n_features, weight, score and rank of every row; rank is null where it isn't drawn.

    Of the N rows with at least min_words words, floor(percent * N / 100) are drawn: those with the highest scores,
    ties to the smaller id (null first), then to fewer n-grams. Words are runs of ASCII digits and letters and of all
    characters beyond ASCII, A-Z lower-cased; n-grams of 1 to `orders` words are joined by one space.

    A null or empty text has no words and weight 0; repeated rows are rows of their own, whose ranks differ; a null id
    takes the noise of an empty one; without rows in `target` all its counts are 0; an empty table gives an empty one;
    columns outside `carry` are neither read nor in the way. Counts cover all rows. Texts are read twice and never
    cross an exchange; ranks come from a sort by ranges, whose sizes (one number each) are all that the driver sees.
    """
    carry = [id_col] if carry is None else carry
    gain = gains(bucket_counts(docs, text=text, orders=orders, buckets=buckets), bucket_counts(target, text=text, orders=orders, buckets=buckets))
    rows = materialised(weights(docs, gain, text=text, id_col=id_col, orders=orders, seed=seed, carry=carry), "weights")
    spark, order = rows.sparkSession, (F.col("score").desc(), F.col("id").asc(), F.col("n_features").asc())
    able = F.col("n_words") >= min_words
    dealt = materialised(rows.where(able).repartitionByRange(parallelism(spark), *order).withColumn("part", F.spark_partition_id()), "ranges")
    offsets, n = [], 0
    for part, size in sorted(tuple(r) for r in dealt.groupBy("part").count().collect()):
        offsets.append((part, n))
        n += size
    before = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = dealt.join(before, "part").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    out = [*unpacked(carry), "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*out))
