"""Benchmark decontamination with an FM-index for each shard of training documents.

A task indexes the words of a shard of its documents: a suffix sort, its Burrows-Wheeler transform in a
wavelet matrix, and the positions of a sample of suffixes. Phrases of the benchmark are found by backward
search with the matrix's ranks, located by walking to the next sampled suffix, and merged to spans. Words
that no phrase has are marks which no match crosses; a run of them is one mark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialised, packed, parallelism, released, scratch, unpacked

WINDOW = 13
SHARD_WORDS = 600_000
SAMPLE = 8
BLOCK_BYTES = 4_000_000
PIECE_WORDS = 10_000
#: A-Z to a-z; digits, a-z and all bytes from 0x80 stay; all others end a word.
WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Phrases:
    """Distinct windows of a block of benchmark items, as numbers of words, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.words: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add("" if item is None else item)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.ids = np.zeros((len(found), window), np.int64)
        for row, p in zip(self.ids, found, strict=True):
            row[window - len(p) :] = p  # right-aligned: the search begins at the end


class Index:
    """FM-index of a sequence of numbers below 2**bits; 0 is a mark, and no two marks compare as equal."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n = n = len(symbols)
        suffixes = self._sorted(symbols, bits)
        before = np.where(suffixes > 0, symbols[suffixes - 1], 0)
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=2**bits))]
        self.before, self.bits = before, bits
        self.zeros, self.split = [], []
        now = before
        for level in range(bits - 1, -1, -1):
            low = (now >> level) & 1 == 0
            self.zeros.append(np.r_[0, np.cumsum(low, dtype=np.int32)].astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            now = np.concatenate([now[low], now[~low]])
        # every SAMPLE-th place is kept, and all that follow a mark, so that no walk crosses one
        sampled = (suffixes % SAMPLE == 0) | (before == 0)
        self.sampled = sampled
        self.place = np.where(sampled, suffixes, -1)

    @staticmethod
    def _sorted(symbols: np.ndarray, bits: int) -> np.ndarray:
        n = len(symbols)
        pos_bits = max(1, n.bit_length())
        depth = max(1, (63 - pos_bits) // bits)
        padded = np.r_[symbols, np.zeros(depth, np.int64)]
        key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(depth):
            s = padded[i : i + n]
            key = key << bits | np.where(open_, s, 0)
            open_ &= s != 0
        key = np.sort(key << pos_bits | np.arange(n))
        order = key & ((1 << pos_bits) - 1)
        key >>= pos_bits
        # equal keys without a mark need a longer look; with one, the earlier place sorts first
        fresh = np.r_[True, key[1:] != key[:-1]] | ~open_[order]
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = start, -1
        tied = np.flatnonzero(~fresh | np.r_[~fresh[1:], False])
        while len(tied):
            places = order[tied]
            a, b = rank[places], rank[np.minimum(places + depth, n)]
            again = np.lexsort((b, a))
            places, a, b = places[again], a[again], b[again]
            order[tied] = places
            fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            start = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
            rank[places] = start
            tied = tied[~fresh | np.r_[~fresh[1:], False]]
            depth *= 2
        return order

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `at` of the transform."""
        low = np.zeros_like(at)
        for level, (zeros, split) in enumerate(zip(self.zeros, self.split, strict=True)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            z, y = zeros[at], zeros[low]
            at, low = np.where(one, split + at - z, z), np.where(one, split + low - y, y)
        return at - low

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrase numbers and places of all occurrences."""
        who = np.arange(len(phrases.lengths))
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.n)
        done: list[tuple[np.ndarray, ...]] = []
        width = phrases.ids.shape[1]
        for step in range(width):
            c = phrases.ids[who, width - 1 - step]
            low, high = (self.first[c], self.first[c + 1]) if step == 0 else (self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high))
            alive = high > low
            whole = alive & (phrases.lengths[who] == step + 1)
            done.append((who[whole], low[whole], high[whole]))
            going = alive & ~whole
            who, low, high = who[going], low[going], high[going]
            if not len(who):
                break
        who, low, high = (np.concatenate(x) for x in zip(*done, strict=True))
        count = high - low
        row = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        return np.repeat(who, count), self._locate(row)

    def _locate(self, row: np.ndarray) -> np.ndarray:
        place, walking, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(walking):
            there = self.sampled[row]
            place[walking[there]] = self.place[row[there]] + steps
            walking, row = walking[~there], row[~there]
            c = self.before[row]
            row = self.first[c] + self.rank(c, row)
            steps += 1
        return place


def search_shard(docs: list[list[int]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """Merged spans of words (start, end) and the items found, for each document given as word numbers (0: in no phrase)."""
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate([np.array(d, np.int64) for d in docs]) if len(docs) else np.zeros(0, np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    known = np.flatnonzero(flat)
    if len(known) and len(phrases.lengths):
        # known words, with one mark wherever words are left out or a document ends
        doc = np.searchsorted(starts, known, "right") - 1
        gap = np.r_[True, (np.diff(known) > 1) | (np.diff(doc) > 0)]
        at = np.arange(len(known)) + np.cumsum(gap)
        symbols = np.zeros(at[-1] + 2, np.int64)
        symbols[at] = flat[known]
        word = np.zeros(len(symbols), np.int64)
        word[at] = known
        who, place = Index(symbols, max(1, len(phrases.words).bit_length())).search(phrases)
        begin = word[place]
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + phrases.lengths[who], -1)
        covered = np.cumsum(change)[:-1] > 0
        inner = np.zeros(len(flat), bool)
        inner[1:] = covered[:-1]
        inner[starts[:-1][sizes > 0]] = False
        opens = np.flatnonzero(covered & ~inner)
        follows = np.r_[covered[1:], False]
        follows[starts[1:][sizes > 0] - 1] = False
        closes = np.flatnonzero(covered & ~follows) + 1
        of = np.searchsorted(starts, opens, "right") - 1
        for d, a, b in zip(of.tolist(), (opens - starts[of]).tolist(), (closes - starts[of]).tolist(), strict=True):
            spans[d].append((a, b))
        pairs = np.unique(np.stack([np.searchsorted(starts, begin, "right") - 1, who]), axis=1)
        for d, w in pairs.T.tolist():
            items[d].update(phrases.items[w])
    return spans, [sorted(x) for x in items]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def pieces(text: str | None, window: int, words: int = PIECE_WORDS) -> list[str]:
    """An item's words in pieces that have every window in one of them; an item of few words, or none, is one piece."""
    found = words_of(text)
    stops = range(0, max(1, len(found) - window + 1), words)
    return [b" ".join(found[i : i + words + window - 1]).decode("utf-8", "surrogatepass") for i in stops]


def find(df: DataFrame, benchmark: DataFrame, *, carry: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Words of every document that lie in an occurrence of a benchmark window, and the items found.

    A window is `window` consecutive words of an item, or all words of a shorter one; an item without words has
    none. Returns the columns in `carry` as they are, the text, n_words, spans (array of start and end in words, merged), items (array of
    item ids as text, sorted, distinct), a row for each input row. Null texts have no words; carried
    columns may hold nulls and repeats (an item's null id counts as empty text); other columns are ignored; empty tables of either
    kind give rows without spans or no rows.

    Items are cut into pieces, made distinct and dealt to blocks of about block_bytes in the shared folder. Tasks
    read documents once, and search each shard of about shard_words words for the blocks one after the other.
    """
    home = scratch(df.sparkSession, "phrases")

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = pieces(text.as_py(), window)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["item", "words"])

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("words"))
    parts = materialised(items.mapInArrow(cut, "item string, words string").where("words <> ''").distinct(), "phrase-pieces")
    total = parts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    parts.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int")).repartition(min(blocks, parallelism(df.sparkSession)), "block").write.partitionBy("block").parquet(home)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    slim = df.select(packed(carry).alias("rest"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))])
    out = slim.mapInArrow(_pass(home, blocks, window, shard_words), schema)
    return out.select(*unpacked(carry), F.col("text").alias(text_col), "n_words", "spans", "items")


def _phrases(home: str, block: int, window: int) -> Phrases:
    fs, base = FileSystem.from_uri(home)
    rows: list[tuple[str, str]] = []
    for info in fs.get_file_info(FileSelector(f"{base}/block={block}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                table = pq.read_table(f, columns=["item", "words"])
            rows += zip(*(c.to_pylist() for c in table.columns), strict=True)
    return Phrases(rows, window)


@lru_cache(maxsize=1)
def _only(home: str, window: int) -> Phrases:
    """The phrases of a benchmark of one block, kept by the process for its next tasks."""
    return _phrases(home, 0, window)


def _pass(home: str, blocks: int, window: int, shard_words: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def shard(texts: list[str | None], docs: list[list], rest: list[pa.Array]) -> pa.RecordBatch:
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        items: list[list[str]] = [[] for _ in docs]
        for block in range(blocks):
            phrases = _only(home, window) if blocks == 1 else _phrases(home, block, window)
            number = phrases.words.get
            own = docs if blocks == 1 else [[number(w, 0) for w in d] for d in docs]
            for i, (s, x) in enumerate(zip(*search_shard(own, phrases), strict=True)):
                spans[i] = merge_spans(spans[i] + s) if spans[i] else s
                items[i] = sorted({*items[i], *x}) if items[i] else x
        arrays = [pa.concat_arrays(rest), pa.array(texts, pa.string()), pa.array(map(len, docs), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=["rest", "text", "n_words", "spans", "items"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _only(home, window).words.get if blocks == 1 else None
        texts, docs, rest, held = [], [], [], 0
        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                docs.append([number(w, 0) for w in words_of(text)] if number else words_of(text))
                texts.append(text)
                held += len(docs[-1])
                if held >= shard_words:
                    rest.append(batch.column(0).slice(start, i + 1 - start))
                    yield shard(texts, docs, rest)
                    texts, docs, rest, held, start = [], [], [], 0, i + 1
            rest.append(batch.column(0).slice(start))
        if texts:
            yield shard(texts, docs, rest)

    return run


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated (at least a twentieth of the words are hit, and one is)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    data = text.encode("utf-8", "surrogatepass")
    plain = data.translate(WORD_BYTES)
    places, at = [], 0
    for w in plain.split():
        at = plain.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    kept, last = [], 0
    for a, b in spans:
        kept.append(data[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*kept, data[last:]]).decode("utf-8", "surrogatepass")


@F.pandas_udf(T.StringType())
def _cleaned(text, spans):
    import pandas as pd

    return pd.Series([t if t is None or not len(s) else without_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object)


def remove_spans(found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """find()'s rows with the spans cut from the text; texts without a span stay as they are."""
    return found.withColumn(text_col, _cleaned(F.col(text_col), F.col("spans")))
