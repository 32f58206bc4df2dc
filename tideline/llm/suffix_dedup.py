"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a string of `length` bytes that also starts earlier goes. Suffixes are not sorted for
all bytes at once: each string of `length` bytes has an anchor in it, the gram with the smallest hash, and
equal strings have equal anchors. Work goes in passes over the documents:

1. Tasks find the anchors of their documents from prefix polynomial hashes, and take a digest (128 bits of SHA-256,
   nothing of the polynomials) of the context that all strings with that anchor can reach, and of where the anchor is
   in it. Of equal contexts within a task only the first is sent on.
2. Anchors meet by their hash. Contexts that have one of equal digest earlier are repeated as a whole.
3. Where one anchor has different contexts, their bytes are fetched. Their suffixes are sorted by a mergesort
   whose comparisons find the common extension by binary search over prefix hashes; suffixes that agree in
   `length` bytes are neighbours then, and are compared byte by byte in case a hash collides. The strings of
   an anchor with very many contexts are dealt to several tasks, by their distance from the anchor.
4. Documents get the spans to remove.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import packed, parallelism, released, scratch, unpacked

LENGTH = 100
GRAM = 32
CHUNK_BYTES = 1_000_000
FLUSH_ANCHORS = 300_000
SORT_WINDOWS = 200_000
HOT_CONTEXTS = 512  # different contexts of an anchor from which its strings are sorted in several pieces
MAX_PIECES = 4
BASE = np.uint64(0x9E3779B97F4A7C15)  # 5 modulo 8: odd, of large order
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHOLE, FETCH, PART = 0, 1, 2
ANCHOR = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("pos", "<u4"), ("part", "<i4"), ("null", "?"), ("pieces", "u1")])


class PrefixHashes:
    """Polynomial hashes of any substrings of one buffer, from prefix sums modulo 2**64."""

    _powers = _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(PrefixHashes._powers) < n:
            PrefixHashes._powers = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)])
            PrefixHashes._inverses = np.cumprod(np.r_[np.uint64(1), np.full(n, INVERSE)])
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[: n - 1], out=self.sums[1:])

    def of(self, start, stop):
        return mixed((self.sums[stop] - self.sums[start]) * self._inverses[start])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads differences to all bits; one-to-one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over every `width` adjacent values."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(docs: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document number, place and hash of all anchors of some documents, and 128 bits of the SHA-256 of their contexts (64 and 64)."""
    kept = [i for i, d in enumerate(docs) if len(d) >= length]
    none = np.zeros(0, np.int64)
    if not kept:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    sizes = np.array([len(docs[i]) for i in kept])
    ends = np.cumsum(sizes)
    joined = b"".join(docs[i] for i in kept)
    data = np.frombuffer(joined, np.uint8)
    n, width = len(data), length - gram + 1
    hashes = PrefixHashes(data)
    h = hashes.of(np.arange(n - gram + 1), np.arange(gram, n + 1)) | np.uint64(1)
    least = sliding(h, width, np.minimum)
    ok = np.ones(len(least), bool)  # strings that cross the end of a document don't count
    for e in ends[:-1].tolist():
        ok[max(0, e - length + 1) : e] = False
    least[~ok] = 0
    around = sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.flatnonzero(h == around)
    doc = np.searchsorted(ends, at, "right")
    first = ends[doc] - sizes[doc]
    start, stop = np.maximum(first, at - (length - gram)), np.minimum(ends[doc], at + length)
    digest = hashlib.sha256
    # the anchor's place goes before the bytes, in a fixed width: a digest is of both
    inside = (at - start).astype("<u4").tobytes()
    both = b"".join([digest(inside[4 * i : 4 * i + 4] + joined[a:b]).digest()[:16] for i, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True))])
    context, check = np.frombuffer(both, "<u8").reshape(-1, 2).T
    return np.array(kept)[doc], at - first, h[at], context, check


def order_of(a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort keys of anchors, least important first: document, then place; null ids are last."""
    return a["pos"], a["row"], a["part"], a["doc"], a["null"]


def first_of_equal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors sorted by anchor, context and order, and which of them are the first of their context."""
    a = a[np.lexsort((*order_of(a), a["check"], a["context"], a["anchor"]))]
    return a, np.r_[True, (a["anchor"][1:] != a["anchor"][:-1]) | (a["context"][1:] != a["context"][:-1]) | (a["check"][1:] != a["check"][:-1])] if len(a) else np.zeros(0, bool)


def sort_suffixes(data: np.ndarray, hashes: PrefixHashes, places: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by bucket and first `length` bytes, and which are equal in both to the one before."""
    eight = sum(data[places + i].astype(np.uint64) << np.uint64(56 - 8 * i) for i in range(8))
    order = np.lexsort((eight, bucket))
    fresh = np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (eight[order][1:] != eight[order][:-1])]
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    size = np.bincount(start, minlength=len(order))[start]
    tied = np.flatnonzero(size > 1)
    slot, items, size, start = tied, order[tied], size[tied], start[tied]
    steps = [1 << b for b in range((length - 1).bit_length() - 1, -1, -1)]
    whole = hashes.of(places, places + length)

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes in common from both places, `length` at most."""
        common = np.zeros(len(a), np.int64)
        for s in steps:
            fits = common + s <= length
            x, y = a + common, b + common
            same = fits & (hashes.of(np.where(fits, x, 0), np.where(fits, x + s, 0)) == hashes.of(np.where(fits, y, 0), np.where(fits, y + s, 0)))
            common += s * same
        return common

    def before(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; or_equal is the answer for suffixes that agree in `length` bytes."""
        out = or_equal.copy()
        differ = np.flatnonzero(whole[x] != whole[y])
        a, b = places[x[differ]], places[y[differ]]
        i = np.minimum(extension(a, b), length - 1)
        out[differ] = data[a + i] < data[b + i]
        return out

    # runs that are in order already, such as those of one string only, need no merging
    run = np.cumsum(np.r_[True, start[1:] != start[:-1]]) - 1 if len(slot) else slot
    inside = np.flatnonzero(run[1:] == run[:-1]) + 1 if len(slot) else slot
    wrong = ~before(items[inside - 1], items[inside], np.ones(len(inside), bool))
    mixed_up = np.zeros(run[-1] + 1 if len(run) else 0, bool)
    mixed_up[run[inside[wrong]]] = True
    slot, items, size, start = (x[mixed_up[run]] for x in (slot, items, size, start))
    width = 1
    here = np.searchsorted(slot, start)  # where each run of ties begins in items
    inner = np.arange(len(slot)) - here
    while len(size) and width < size.max():
        block = inner // width
        other = np.where(block % 2 == 0, (block + 1) * width, (block - 1) * width)
        low = np.minimum(other, size)
        lo, hi = low.copy(), np.minimum(other + width, size)
        left_side = block % 2 == 0
        while (going := np.flatnonzero(lo < hi)).size:
            mid = (lo[going] + hi[going]) // 2
            # an element of the left block precedes equal ones of the right block
            passed = before(items[here[going] + mid], items[going], ~left_side[going])
            lo[going] = np.where(passed, mid + 1, lo[going])
            hi[going] = np.where(passed, hi[going], mid)
        pair = np.where(left_side, block, block - 1) * width
        to = here + pair + (inner - block * width) + (lo - low)
        moved = np.empty_like(items)
        moved[to] = items
        items = moved
        width *= 2
    order[slot] = items
    equal = np.zeros(len(order), bool)
    close = np.flatnonzero(~fresh)
    close = close[whole[order[close]] == whole[order[close - 1]]]
    a, b = places[order[close]], places[order[close - 1]]
    for i in range(0, len(close), 50_000):
        part = slice(i, i + 50_000)
        span = np.arange(length)
        really = (data[a[part, None] + span] == data[b[part, None] + span]).all(axis=1)
        equal[close[part][really]] = True
    return order, equal


class Contexts:
    """Contexts of anchors as columns: anchor records, where in the document each starts, and its bytes in one buffer."""

    def __init__(self, records: np.ndarray, begin: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.records, self.begin, self.sizes, self.data = records, begin, sizes, data
        self.offsets = np.cumsum(sizes) - sizes

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> Contexts:
        parts = [pickle.loads(b) for b in blobs]
        join = lambda i, kind: np.concatenate([np.frombuffer(p[i], kind) for p in parts]) if parts else np.zeros(0, kind)
        return cls(join(0, ANCHOR), join(1, np.int64), join(2, np.int64), join(3, np.uint8))

    def take(self, rows: np.ndarray) -> Contexts:
        sizes = self.sizes[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.offsets[rows] - (np.cumsum(sizes) - sizes), sizes)
        return Contexts(self.records[rows], self.begin[rows], sizes, self.data[at])


def repeated_windows(found: Contexts, length: int) -> Iterator[tuple[int, int, int, int]]:
    """part, row, start and stop of strings that start earlier too; anchors are taken together up to SORT_WINDOWS strings."""
    order = np.argsort(found.records["anchor"], kind="stable")
    anchor = found.records["anchor"][order]
    ends = np.r_[np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(order)] if len(order) else []
    windows = np.r_[0, np.cumsum(found.sizes[order] - length + 1)]
    at = 0
    for k, end in enumerate(ends):
        if k + 1 == len(ends) or windows[ends[k + 1]] - windows[at] > SORT_WINDOWS:
            yield from _repeated(found.take(order[at:end]), length)
            at = end


def _repeated(group: Contexts, length: int) -> Iterator[tuple[int, int, int, int]]:
    """As repeated_windows(), for whole anchors. Equal strings have their anchor at the same distance: distances are sorted in turn, so that memory follows the number of contexts."""
    a, begin, count = group.records, group.begin, group.sizes - length + 1
    before = a["pos"].astype(np.int64) - begin
    bucket = np.unique(a["anchor"], return_inverse=True)[1]
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort(order_of(a))] = np.arange(len(a))
    data = np.concatenate([group.data, np.zeros(8, np.uint8)])
    hashes = PrefixHashes(data)
    step = max(1, int(before.max() + 1) * SORT_WINDOWS // max(int(count.sum()), 1))
    found = []
    for d in range(0, int(before.max()) + 1, step):
        low, high = np.maximum(d, before - count + 1), np.minimum(d + step - 1, before)
        n = np.maximum(0, high - low + 1)
        who = np.repeat(np.arange(len(a)), n)
        distance = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        inner = before[who] - distance
        places, key = group.offsets[who] + inner, bucket[who] * 1_000 + distance
        # a string whose hash no other has in its bucket has no equal there
        _, number, times = np.unique(mixed(hashes.of(places, places + length) ^ mixed(key.astype(np.uint64))), return_inverse=True, return_counts=True)
        shared = times[number] > 1
        if shared.any():
            who, inner, places, key = (x[shared] for x in (who, inner, places, key))
            order, equal = sort_suffixes(data, hashes, places, key, length)
            cls, own = np.cumsum(~equal) - 1, rank[who[order]]
            first = np.full(cls[-1] + 1, len(a))
            np.minimum.at(first, cls, own)
            again = order[own > first[cls]]
            found.append((who[again], inner[again]))
    if found:
        who, inner = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((inner, who))
        who, inner = who[order], inner[order]
        if len(who):
            opens = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (np.diff(inner) > 1)])
            closes = np.r_[opens[1:], len(who)] - 1
            w = who[opens]
            yield from zip(a["part"][w].tolist(), a["row"][w].tolist(), (begin[w] + inner[opens]).tolist(), (begin[w] + inner[closes] + length).tolist(), strict=True)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str], kept: str | None = None, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Spans of bytes covered by strings of `length` bytes that start earlier too.

    Returns the columns in `carry` as they are, the text, spans (array of start and end in UTF-8 bytes: maximal runs), a row for each input
    row; with kept="text" also kept, the text without its spans (a character that is cut in part goes as a whole), with
    kept="sha256" the digest of the bytes that are left. Earlier is: smaller id (long), or the same document and an earlier start; of rows with equal ids, that
    read first; null ids come last. Matches never cross rows. Null and short texts have no spans; carried
    columns may hold anything, other columns are ignored; an empty table gives no rows. Results of the passes are tables in the shared folder.
    """
    spark, n = df.sparkSession, parallelism(df.sparkSession)
    home = scratch(spark, "suffix-dedup")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    docs = df.select(F.spark_partition_id().alias("part"), row.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), packed(carry).alias("rest"))
    docs.write.option("compression", "zstd").parquet(f"{home}/docs")
    docs = spark.read.schema(docs.schema).parquet(f"{home}/docs")
    blobs = "pid int, part int, kind int, data binary"
    texts = docs.select("part", "row", "id", "text")
    dealt = texts.mapInArrow(_find_anchors(length, gram, n), blobs).repartition(n, "pid")
    flags = dealt.mapInArrow(_match_contexts(hot_contexts), blobs)
    flags.repartition(n, "part").write.partitionBy("part").parquet(f"{home}/flags")
    wanted = texts.mapInArrow(_fetch(f"{home}/flags", length, gram, n), blobs).repartition(n, "pid")
    wanted.mapInArrow(_sort_contexts(length), blobs).repartition(n, "part").write.partitionBy("part").parquet(f"{home}/parts")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema["rest"], T.StructField("text", T.StringType()), T.StructField("spans", span), T.StructField("kept", T.StringType())])
    out = docs.mapInArrow(_apply(f"{home}/flags", f"{home}/parts", length, gram, kept), schema)
    return out.select(*unpacked(carry), F.col("text").alias(text_col), "spans", *(["kept"] if kept else []))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int | None, str | None]]:
    for batch in batches:
        for part, row, i, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
            yield part, row, i, text.as_py()


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    pid, part, kind, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["pid", "part", "kind", "data"])


def _by(keys: np.ndarray, a: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of a by key, in a's order within each."""
    order = np.argsort(keys, kind="stable")
    keys, a = keys[order], a[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, int)
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(keys[s]), a[s:e]


def _packed(a: np.ndarray, names: tuple[str, ...] = ANCHOR.names) -> bytes:
    return pickle.dumps({k: np.ascontiguousarray(a[k]).tobytes() for k in names})


def _places(a: np.ndarray) -> bytes:
    """What is left to know of contexts that are repeated as a whole."""
    return _packed(a[np.lexsort((a["pos"], a["row"]))], ("row", "pos"))


def _unpacked(data: bytes) -> np.ndarray:
    columns = pickle.loads(data)
    a = np.zeros(len(columns["row"]) // 4, ANCHOR)
    for k in columns:
        a[k] = np.frombuffer(columns[k], ANCHOR[k])
    return a


def _find_anchors(length: int, gram: int, n: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        docs: list[tuple] = []
        size = 0

        def take() -> None:
            doc, pos, anchor, context, check = anchors([d[3] for d in docs], length, gram)
            a = np.zeros(len(doc), ANCHOR)
            a["anchor"], a["context"], a["check"], a["pos"] = anchor, context, check, pos
            for k, v in (("part", 0), ("row", 1), ("doc", 2)):
                a[k] = np.array([d[v] or 0 for d in docs], np.int64)[doc]
            a["null"] = np.array([d[2] is None for d in docs])[doc]
            held.append(a)

        def send() -> pa.RecordBatch:
            a, first = first_of_equal(np.concatenate(held))
            rows = [(int(part) % n, int(part), WHOLE, _places(x)) for part, x in _by(a["part"][~first], a[~first])]
            a = a[first]
            a = a[np.lexsort(order_of(a))]  # columns of near rows compress better
            rows += [(pid, 0, FETCH, _packed(x)) for pid, x in _by((a["anchor"] >> np.uint64(20)) % np.uint64(n), a)]
            return _blobs(rows)

        for part, row, i, text in _rows(batches):
            docs.append((part, row, i, _bytes(text)))
            size += len(docs[-1][3])
            if size >= CHUNK_BYTES:
                take()
                docs, size = [], 0
                if sum(map(len, held)) >= FLUSH_ANCHORS:
                    yield send()
                    held.clear()
        if docs:
            take()
        if held:
            yield send()

    return run


def _match_contexts(hot: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == WHOLE:
                    yield _blobs([(0, row["part"], WHOLE, row["data"])])
                else:
                    held.append(_unpacked(row["data"]))
        if not held:
            return
        a = np.concatenate(held)
        held.clear()
        a = a[np.argsort(a["anchor"])]
        again = a["anchor"][1:] == a["anchor"][:-1]
        a, first = first_of_equal(a[np.r_[again, False] | np.r_[False, again]])
        yield _blobs([(0, part, WHOLE, _places(x)) for part, x in _by(a["part"][~first], a[~first])])
        a = a[first]
        again = a["anchor"][1:] == a["anchor"][:-1]
        a = a[np.r_[again, False] | np.r_[False, again]] if len(a) else a
        _, number, times = np.unique(a["anchor"], return_inverse=True, return_counts=True)
        a["pieces"] = np.clip(-(-times // hot), 1, MAX_PIECES)[number]
        yield _blobs([(0, part, FETCH, _packed(x)) for part, x in _by(a["part"], a)])

    return run


class _Side:
    """Flags of the part that is being read, from a table in the shared folder that is laid out by part."""

    def __init__(self, path: str, kind: int):
        self.fs, self.path = FileSystem.from_uri(path)
        self.kind, self.part, self.rows = kind, None, {}

    def of(self, part: int, row: int) -> list:
        if part != self.part:
            self.part, self.rows = part, {}
            for info in self.fs.get_file_info(FileSelector(f"{self.path}/part={part}", allow_not_found=True)):
                if info.path.endswith(".parquet"):
                    with self.fs.open_input_file(info.path) as f:
                        for x in pq.read_table(f, columns=["kind", "data"]).to_pylist():
                            if x["kind"] == self.kind == PART:
                                for r, s, e in pickle.loads(x["data"]):
                                    self.rows.setdefault(r, []).append((s, e))
                            elif x["kind"] == self.kind:
                                for r, own in _by(a["row"], a) if len(a := _unpacked(x["data"])) else ():
                                    self.rows.setdefault(r, []).append(own)
        return self.rows.get(row, [])


def in_pieces(a: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Which anchor each piece is of, its number, and where it starts and stops in the document (not held to its ends).

    Equal strings have their anchor at the same distance from their start: a piece has the strings of some
    distances, so that pieces of an anchor can be sorted in tasks of their own.
    """
    pieces = np.maximum(a["pieces"].astype(np.int64), 1)
    at = np.repeat(np.arange(len(a)), pieces)
    number = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    distances, pos = length - gram + 1, a["pos"].astype(np.int64)[at]
    nearest, farthest = number * distances // pieces[at], (number + 1) * distances // pieces[at] - 1
    return at, number, np.maximum(0, pos - farthest), pos - nearest + length


def _fetch(flags: str, length: int, gram: int, n: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, size = _Side(flags, FETCH), 0
        held: tuple[list, ...] = ([], [], [], [])

        def send() -> pa.RecordBatch:
            a, begin, number = (np.concatenate(x) for x in held[:3])
            sizes = np.array([len(x) for x in held[3]], np.int64)
            found = Contexts(a, begin, sizes, np.frombuffer(b"".join(held[3]), np.uint8))
            rows = []
            for pid, own in _by(((a["anchor"] >> np.uint64(20)) + number.astype(np.uint64)) % np.uint64(n), np.arange(len(a))):
                x = found.take(own)
                rows.append((pid, 0, FETCH, pickle.dumps((x.records.tobytes(), x.begin.tobytes(), x.sizes.tobytes(), x.data.tobytes()))))
            return _blobs(rows)

        for part, row, _, text in _rows(batches):
            own = side.of(part, row)
            if own:
                data = _bytes(text)
                for a in own:
                    at, number, start, stop = in_pieces(a, length, gram)
                    whole = np.minimum(stop, len(data)) - start >= length  # near an end, a piece may have no string
                    at, number, start, stop = at[whole], number[whole], start[whole], stop[whole]
                    held[0].append(a[at]), held[1].append(start), held[2].append(number)
                    held[3].extend(data[s:e] for s, e in zip(start.tolist(), stop.tolist(), strict=True))
                    size += len(at)
                if size >= 50_000:
                    yield send()
                    held, size = ([], [], [], []), 0
        if size:
            yield send()

    return run


def _sort_contexts(length: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Contexts.unpacked([data for batch in batches for data in batch.column(3).to_pylist()])
        parts: dict[int, list] = {}
        for part, row, s, e in repeated_windows(found, length):
            parts.setdefault(part, []).append((row, s, e))
        yield _blobs([(0, part, PART, pickle.dumps(x)) for part, x in parts.items()])

    return run


def _apply(flags: str, parts: str, length: int, gram: int, kept: str | None):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, some = _Side(flags, WHOLE), _Side(parts, PART)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece, out, rest = batch.slice(at, 500), [], []
                for part, row, _, text in _rows([piece]):
                    spans = list(some.of(part, row))
                    found = whole.of(part, row)
                    if found:
                        n = len(_bytes(text))
                        for a in found:
                            pos = a["pos"].astype(np.int64)
                            spans += zip(np.maximum(0, pos - (length - gram)).tolist(), np.minimum(n, pos + length).tolist(), strict=True)
                    spans = merged(spans)
                    out.append([{"start": s, "end": e} for s, e in spans])
                    if kept == "sha256":
                        rest.append(hashlib.sha256(_without(text, spans)).hexdigest())
                    else:
                        rest.append(_without(text, spans).decode("utf-8", "ignore") if kept and spans else text if kept else None)
                yield pa.RecordBatch.from_arrays([piece.column(4), piece.column(3), pa.array(out, span), pa.array(rest, pa.string())], names=["rest", "text", "spans", "kept"])

    return run


def _without(text: str | None, spans: list[tuple[int, int]]) -> bytes:
    data, parts, last = _bytes(text), [], 0
    for s, e in spans:
        parts.append(data[last:s])
        last = e
    return b"".join([*parts, data[last:]])


def with_counts(found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds n_bytes, n_removed and n_spans."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "n_removed": removed, "n_spans": F.size("spans").cast("long")})
