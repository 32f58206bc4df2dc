"""SimHash near-duplicates with pivot distance tables.

Fingerprints that differ in few bits have nearly the same distance to every reference fingerprint: rows are
sorted by their distance to one, and paired only while those distances differ by the allowed bits or fewer; the
largest difference over all pivots discards pairs next, and only survivors are compared bit by bit. As distances to pivots alone can't deal rows out to tasks, rows meet by blocks of bits:
of five blocks, three differing bits leave two untouched, so that every link shares the bits of one of ten
pairs of blocks.

similar() links texts by the Jaccard index of their shingle sets instead. Texts meet by bands of their smallest shingle
hashes, of 64 bits each, so that the candidates of a text don't grow with the number of other texts; then pivots and a
radius of 128-bit fingerprints, which follows from the index, discard pairs, and the index itself, over the shingles'
own bytes, decides on all that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import chunks, free_name, matched, materialised, numbered, parallelism, released

SHINGLE = 3
HASH_SEED = 42
MAX_BITS = 3
PIVOTS = 32
SORT_PIVOTS = 8
PIVOT_SEED = 5
GROUP_ROWS = 2_048
CHUNK_BYTES = 4_000_000
HASHES_AT_ONCE = 100_000
SKETCH_AT_ONCE = 5_000
#: For similar(): the share of pairs at the least similarity that the radius reaches, bands and smallest hashes in each
#: (a pair of Jaccard 0.8 shares a band with a chance of 0.9996), parts of a band's texts, and text in a piece of a group.
REACH = 0.99
BANDS, BAND_HASHES = 20, 5
SALTS = 64
PIECE_BYTES = 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text: the majority of each bit over the hashes of all word shingles.

    A-Z are lower-cased, words end at ASCII white space; a text of fewer words is one shingle, and one without
    words has 0. A bit that exactly half the hashes have is 0.
    """
    return int.from_bytes(majority(*cuts(text, shingle), xxhash.xxh64_digest, 8), "big")


def cuts(text: str | None, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a text, joined by spaces, and where its shingles start and stop in them."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return b"", [], []
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(shingle, len(words))
    return b" ".join(words), [0, *ends[:-1].tolist()], (ends[size - 1 :] - 1).tolist()


def majority(joined: bytes, starts: list[int], stops: list[int], digest: Callable[[bytes, int], bytes], size: int) -> bytes:
    """The majority of each bit over the digests (of `size` bytes) of all shingles; zeros if there is none."""
    n, ones = len(stops), np.zeros(8 * size, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        hashes = b"".join([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[at : at + HASHES_AT_ONCE], stops[at : at + HASHES_AT_ONCE], strict=False)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, size), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fp (the fingerprint's bits as a long), a row for each input row; null texts have fingerprint 0."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, CHUNK_BYTES):
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def block_keys(fp: str, max_bits: int):
    """Keys under which all fingerprints within max_bits of each other meet: bits of all pairs of max_bits + 2 blocks."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for number, (x, y) in enumerate(combinations(range(n), 2)):
        mask = masks[x] | masks[y]
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).cast("byte").alias("table"), F.col(fp).bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def links_within(table: np.ndarray, bits: np.ndarray, group: np.ndarray, fps: np.ndarray, max_bits: int, accept: Callable[[int, int], bool] | None = None, formed: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect, within each group of adjacent rows, all fingerprints that differ in max_bits or fewer.

    Every group is sorted by its distances to a pivot, that of a few whose distances spread most. A row is paired
    with those after it up to the first that is over max_bits further from the pivot: no other pair is formed.
    The other pivots discard pairs next, and what survives is compared bit by bit. A fingerprint is a number or
    a row of numbers. With accept, pairs must pass that too. Of links that close a circle one is left out, so that
    a group gives fewer links than it has rows. formed gets the number of pairs formed.
    """
    fps = fps.reshape(len(fps), -1)
    n = len(fps)
    pivots = np.random.default_rng(PIVOT_SEED).integers(0, 2**64, (PIVOTS, fps.shape[1]), np.uint64, endpoint=False)
    apart = lambda x, y: sum(np.bitwise_count(x[..., k] ^ y[..., k]).astype(np.int16) for k in range(fps.shape[1]))
    distances = apart(fps[:, None], pivots)
    starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (bits[1:] != bits[:-1]) | (group[1:] != group[:-1])]) if n else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    spread = np.maximum.reduceat(distances[:, :SORT_PIVOTS], starts) - np.minimum.reduceat(distances[:, :SORT_PIVOTS], starts) if n else distances[:, :SORT_PIVOTS]
    near = distances[np.arange(n), spread.argmax(axis=1)[own]] if n else np.zeros(0, np.int16)
    order = np.lexsort((near, own))  # of sorted places; groups stay where they are
    near, distances, fps = near[order], distances[order], fps[order]
    last = np.searchsorted(own.astype(np.int64) * 1_000 + near, own.astype(np.int64) * 1_000 + near + max_bits, "right") - 1
    parent = np.arange(n).tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out, left, lag = [], np.arange(n), 0
    missing = np.bincount(own, minlength=len(starts)) - 1  # links that a group lacks until all its rows are connected
    while len(left):
        if accept is not None:
            left = left[missing[own[left]] > 0]
        lag += 1
        left = left[left + lag <= last[left]]
        pairs = left
        if formed is not None:
            formed.append(len(pairs))
        for p in range(0, PIVOTS, 8):
            pairs = pairs[np.abs(distances[pairs, p : p + 8] - distances[pairs + lag, p : p + 8]).max(axis=1, initial=0) <= max_bits]
        pairs = pairs[apart(fps[pairs], fps[pairs + lag]) <= max_bits]
        for i, j in zip(order[pairs].tolist(), order[pairs + lag].tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b and (accept is None or accept(i, j)):
                parent[a] = b
                missing[own[i]] -= 1
                out.append((i, j))
    return out


def links(distinct: DataFrame, *, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) within max_bits, of which every chain is kept.

    Rows that share a key meet in one task. A key with more than group_rows rows is cut into pieces, and every
    two pieces meet in a group of their own, so that no group grows with the input and no link is lost.
    """
    keyed = distinct.select("fp", F.explode(block_keys("fp", max_bits)).alias("k")).select("k.table", "k.bits", "fp")
    busy = keyed.groupBy("table", "bits").count().where("count > 1").withColumn("pieces", F.ceil(F.col("count") / group_rows).cast("int")).drop("count")
    rows = keyed.join(materialised(busy, "busy-keys"), ["table", "bits"])
    own, other = F.pmod(F.xxhash64("fp"), F.col("pieces")), F.col("other")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select("table", "bits", (F.least(own, other) * F.col("pieces") + F.greatest(own, other)).cast("long").alias("group"), "fp")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]):
                changed = np.flatnonzero(reduce(np.logical_or, [x[1:] != x[:-1] for x in held[:3]]))
                cut = changed[-1] + 1 if len(changed) else 0
                if cut:
                    yield found([x[:cut] for x in held])
                    held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield found(held)

    def found(held: list[np.ndarray]) -> pa.RecordBatch:
        table, bits, group, fp = held
        pairs = np.array(links_within(table, bits, group, fp.view(np.uint64), max_bits), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], names=["a", "b"])

    dealt = rows.repartition(parallelism(distinct.sparkSession), "table", "bits", "group").sortWithinPartitions("table", "bits", "group", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Fingerprint and component of every document: id_col, fingerprint (16 hex digits), component_id.

    Documents link where their fingerprints differ in max_bits or fewer; component_id is the smallest id that
    links reach (of a component with null ids only, null). A row for each input row: null and empty texts share
    fingerprint 0; ids may be null or repeated; other columns are ignored; an empty table gives no rows.
    Copies are one fingerprint in the search, which works on distinct fingerprints only.
    """
    rows = materialised(fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    distinct = materialised(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = connected_components(links(distinct, max_bits=max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialised(rooted, "rooted-fingerprints")
    linked = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    components = materialised(rooted.join(linked, "root").select("fp", "component_id"), "fingerprint-components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(components, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def radius(similarity: float, bits: int = 128) -> int:
    """The bits within which REACH of all pairs of just that Jaccard index lie.

    Sets of index s have a cosine of 2s / (1 + s) at least, and each bit differs with chance arccos / pi.
    """
    p, total = acos(2 * similarity / (1 + similarity)) / pi, 0.0
    for r in range(bits + 1):
        total += comb(bits, r) * p**r * (1 - p) ** (bits - r)
        if total >= REACH:
            return r
    return bits


def band_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors that make a hash function for each place of each band out of one 64-bit hash."""
    rng = np.random.default_rng(PIVOT_SEED)
    draw = lambda: rng.integers(0, 2**64, BANDS * BAND_HASHES, np.uint64, endpoint=False)
    return draw(), draw() | np.uint64(1)


def sketch(joined: bytes, starts: list[int], stops: list[int], masks: np.ndarray, factors: np.ndarray) -> tuple[bytes, list[int]]:
    """128 bits of SimHash of all shingles, and of every band a 64-bit hash of its smallest shingle hashes; without shingles zeros and no bands."""
    n, ones, least = len(stops), np.zeros(128, np.int64), np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, n, SKETCH_AT_ONCE):
        raw = b"".join([xxhash.xxh3_128_digest(joined[a:b], HASH_SEED) for a, b in zip(starts[at : at + SKETCH_AT_ONCE], stops[at : at + SKETCH_AT_ONCE], strict=False)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
        hashes = np.frombuffer(raw, np.uint64)[::2]
        np.minimum(least, ((hashes[:, None] ^ masks) * factors).min(axis=0), out=least)
    bands = [xxhash.xxh64_intdigest(least[k : k + BAND_HASHES].tobytes(), k) for k in range(0, len(least), BAND_HASHES)] if n else []
    return np.packbits(2 * ones > n).tobytes(), np.array(bands, np.uint64).view(np.int64).tolist()


def prints(df: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """n (the id), hi and lo (128 bits of SimHash), bands, words (a 128-bit digest of the words, null if there are none) and size (their bytes)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, factors = band_hashes()
        for batch in chunks(batches, 1, CHUNK_BYTES):
            found = [cuts(t.as_py(), shingle) for t in batch.column(1)]
            drawn = [sketch(*x, masks, factors) for x in found]
            fps = np.frombuffer(b"".join(x[0] for x in drawn), ">i8").astype(np.int64).reshape(-1, 2)
            words = pa.array([xxhash.xxh3_128_digest(x[0], HASH_SEED) if x[0] else None for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array([x[1] for x in drawn], pa.list_(pa.int64())), words, pa.array([len(x[0]) for x in found], pa.int64())], names=["n", "hi", "lo", "bands", "words", "size"])

    return df.select(F.col(id_col).alias("n"), F.col(text_col).alias("text")).mapInArrow(run, "n long, hi long, lo long, bands array<long>, words binary, size long")


def by_group(batches: Iterator[pa.RecordBatch], keys: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of adjacent rows that are equal in the first columns, about `limit` rows of them at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held = [pa.concat_batches([*held, batch])] if held else [batch]
        if held[0].num_rows < 2:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in held[0].columns[:keys]]
        starts = np.flatnonzero(reduce(np.logical_or, [x[1:] != x[:-1] for x in columns])) + 1
        at = 0
        while len(starts) and at < starts[-1]:
            end = int(starts[max(np.searchsorted(starts, at + limit, "right") - 1, np.searchsorted(starts, at, "right"))])
            yield held[0].slice(at, end - at)
            at = end
        held = [held[0].slice(at)]
    if held and held[0].num_rows:
        yield held[0]


def pieced(rows: DataFrame, own, keys: list[str], columns: list[str]) -> DataFrame:
    """rows, each repeated for every group in which its piece (own, of `pieces`) meets another piece of its key, so dealt and sorted that groups are adjacent."""
    rows = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))})
    rows = rows.select(*keys, (F.least("own", "other") * F.col("pieces") + F.greatest("own", "other")).cast("long").alias("group"), *columns)
    return rows.repartition(parallelism(rows.sparkSession), *keys, "group").sortWithinPartitions(*keys, "group", columns[0])


def candidates(texts: DataFrame) -> DataFrame:
    """Links (a, b: values of n) that connect all texts (n, bands) which share a band.

    All texts of a band are candidates of each other, so that links to one of them will do. A band's texts are dealt
    to SALTS parts: links lead to the first of a part, and from there to the first of the band.
    """
    keyed = texts.select("n", F.posexplode("bands").alias("band", "key")).withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALTS)))
    part = Window.partitionBy("band", "key", "salt")
    rows = keyed.withColumns({"first": F.min("n").over(part)})
    firsts = keyed.groupBy("band", "key", "salt").agg(F.min("n").alias("first"))
    inner = rows.where("n <> first").select(F.col("n").alias("a"), F.col("first").alias("b"))
    outer = firsts.withColumn("b", F.min("first").over(Window.partitionBy("band", "key"))).where("first <> b").select(F.col("first").alias("a"), "b")
    return inner.unionByName(outer)


def confirmed(texts: DataFrame, *, shingle: int, similarity: float, max_bits: int) -> DataFrame:
    """Links (a, b: values of n) that connect the texts of a root within max_bits whose Jaccard index is similarity or more."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_group(batches, 2, 200):
            root, group, n, hi, lo = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]]
            sets: dict[int, frozenset[bytes]] = {}

            def shingles(i: int, texts=batch.column(5), sets=sets) -> frozenset[bytes]:
                if i not in sets:
                    joined, starts, stops = cuts(texts[i].as_py(), shingle)
                    sets[i] = frozenset(joined[a:b] for a, b in zip(starts, stops, strict=False))
                return sets[i]

            def alike(i: int, j: int, shingles=shingles) -> bool:
                return at_least(shingles(i), shingles(j), similarity)

            found = np.array(links_within(root, group, group, np.stack([hi, lo], axis=1).view(np.uint64), max_bits, alike), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(n[found[:, 0]]), pa.array(n[found[:, 1]])], names=["a", "b"])

    return pieced(texts, F.pmod(F.xxhash64("n"), F.col("pieces")), ["root"], ["n", "hi", "lo", "text"]).mapInArrow(run, "a long, b long")


def at_least(a: frozenset, b: frozenset, similarity: float) -> bool:
    """Whether the Jaccard index of two sets is similarity or more."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large - 1e-9:
        return False
    both = len(a & b)
    return both >= similarity * (small + large - both) - 1e-9


def similar(df: DataFrame, *, id_col: str, text_col: str = "text", shingle: int, similarity: float) -> DataFrame:
    """id_col and component_id of every row of a numbered() table with that column; texts link where their shingle sets have a Jaccard index of similarity or more.

    Rows with the same words are one text; texts without words are one component. Texts that share a band are
    candidates; of each connected group of candidates all pairs within the radius are compared by their shingles, but
    those that are connected already. What is lost are pairs that no chain of bands connects, or beyond the radius.
    """
    bits = radius(similarity)
    rows = materialised(prints(df, id_col=id_col, text_col=text_col, shingle=shingle), "prints")
    texts = materialised(rows.groupBy("words").agg(F.min("n").alias("n"), F.min("hi").alias("hi"), F.min("lo").alias("lo"), F.any_value("bands").alias("bands"), F.max("size").alias("size")), "distinct-words")
    worded = texts.where("words is not null")
    roots = connected_components(candidates(worded.select("n", "bands")))
    rooted = worded.join(roots.withColumnRenamed("node", "n"), "n").select("n", "hi", "lo", "size", "root")
    rooted = materialised(rooted, "rooted-texts")
    pieces = F.ceil(F.greatest(F.col("count") / GROUP_ROWS, F.col("bytes") / PIECE_BYTES)).cast("int")
    groups = rooted.groupBy("root").agg(F.count("*").alias("count"), F.sum("size").alias("bytes")).where("count > 1").select("root", pieces.alias("pieces"))
    members = materialised(rooted.join(groups, "root").select("n", "root", "hi", "lo", "pieces"), "members")
    both = matched(df.select(F.col(id_col).alias("n"), F.col(text_col).alias("text")), members, "n")
    found = connected_components(confirmed(both, shingle=shingle, similarity=similarity, max_bits=bits))
    components = texts.join(found.withColumnRenamed("node", "n"), "n", "left").select("words", F.coalesce("root", "n").alias("component_id"))
    components = materialised(components, "text-components")
    return rows.join(components, rows["words"].eqNullSafe(components["words"])).select(F.col("n").alias(id_col), "component_id")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """df with one row of each component of near_duplicates(): that with the smallest id, null ids last, the first read among equals.

    With similarity, components are those of similar() instead, and max_bits is not used.

    Rows are told apart by a number of their own, so that repeated and null ids are rows like any other.
    """
    row = free_name(df, "row")
    rows = numbered(df, row, "numbered")
    if similarity is None:
        found = near_duplicates(rows, id_col=row, text_col=text_col, shingle=shingle, max_bits=max_bits)
    else:
        found = similar(rows, id_col=row, text_col=text_col, shingle=shingle, similarity=similarity)
    own = rows.select(F.col(row).alias("n"), F.col(id_col).alias("id"))
    best = found.select(F.col(row).alias("n"), "component_id").join(own, "n").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "n")).alias("best"))
    return matched(rows, best.select(F.col("best.n").alias(row)), row).drop(row)
