"""Spelling variants: words one edit apart, found by pivotal grams, and the commoner form that each word leads to."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER
from .shared import materialised

#: letters of a word: both cases of ASCII and all code points of a block beyond it
RUN = "([A-Za-zÀ-ÿ]+)"
#: bigrams of such words once A-Z are lower-cased: a bound on what goes to the driver and to every task
MAX_GRAMS = (26 + 64) ** 2
#: grams that one edit of a word can touch, and one more
PREFIX, PIVOTS = 3, 2
#: unchanged parts of fewer code points than this are joined by a part of the word's rest
SHORT = 4


def count_words(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", min_length: int = 5, min_count: int = 3, noise: int | None = None) -> DataFrame:
    """Columns word and n: runs of letters, A-Z lower-cased, of at least min_length code points and min_count occurrences.

    With `noise`, one in so many runs loses a letter first, always the same one of the same run in the same document:
    the CRC-32 of id, colon and run decides. A null or empty text has no words; a null id counts as an empty one.
    Occurrences are added up before they move.
    """
    runs = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN), 1)).alias("run")).where(F.char_length("run") >= min_length)
    low = F.when(F.char_length("run") == F.octet_length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    words = runs.select("id", low.alias("word"))
    if noise:
        h = F.crc32(F.concat_ws(":", F.coalesce("id", F.lit("")), "word"))
        at = (h % F.char_length("word")).cast("int")
        words = words.select(F.when(h % noise == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def pivots(grams: list[tuple[int, int, int]], number: int = PIVOTS) -> list[tuple[int, int, int]]:
    """`number` disjoint grams of (cost, rank, position) with the least total cost: the best choice up to each position, with one more or without."""
    best: list[list[tuple[int, tuple] | None]] = []
    ordered = sorted(grams, key=lambda g: g[2])
    for i, gram in enumerate(ordered):
        clear = max((j for j in range(i) if ordered[j][2] + 2 <= gram[2]), default=-1)
        row: list[tuple[int, tuple] | None] = [(0, ())]
        for k in range(1, number + 1):
            without = best[i - 1][k] if i else None
            under = (best[clear][k - 1] if clear >= 0 else None) if k > 1 else (0, ())
            choice = (under[0] + gram[0], (*under[1], gram)) if under else None
            row.append(min((c for c in (without, choice) if c), key=lambda c: c[0], default=None))
        best.append(row)
    return list(best[-1][number][1])


def grams_of(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The word's prefix of rare grams, each as (cost, rank, position), and its pivots.

    The prefix are the PREFIX rarest, and all others that equal the last of them, so that it holds every gram of the word up to a rank.
    """
    found = sorted(((*order[word[i : i + 2]], i) for i in range(len(word) - 1)), key=lambda g: g[1:])
    head = [g for g in found if g[1] <= found[PREFIX - 1][1]]
    return head, pivots(head[:PREFIX])


def keys_of(word: str, at: int, is_pivot: bool) -> Iterator[str]:
    """Keys that the word shares with its near words where the gram at a position is unchanged: a pivot's for the words sought, or a prefix gram's for the word found.

    The edit is behind the gram or before it. So all before it, or all behind it, is unchanged with the gram: that
    part, its side and the length of the word found fix the gram's position. A short part is shared by many words. It
    gets company: with h half the rest of the shorter word, the h code points of the rest that touch the part are
    unchanged, or all of the shorter rest but h at the other end.
    """
    size = len(word)
    for side, part, rest in (("<", word[: at + 2], word[at + 2 :]), (">", word[at:], word[:at][::-1])):
        for other in (size - 1, size, size + 1):
            found = other if is_pivot else size
            if len(part) >= SHORT:
                if is_pivot or other == size:
                    yield f"{side}{found}{part}"
                continue
            shorter = min(size, other) - len(part)
            if shorter < 0:
                continue
            half, lengths = shorter // 2, f"{found}:{size if is_pivot else other}"
            yield f"{side}{lengths}{part}+{rest[:half]}"
            yield f"{side}{lengths}{part}-{rest[len(rest) - (shorter - half) :]}"


def near_pairs(words: DataFrame) -> DataFrame:
    """Columns a, b, n_a, n_b: every pair of words (a < b) that one inserted, deleted or replaced code point tells apart, once.

    words: columns word (each once, of at least 4 code points of RUN's alphabet) and n.

    Of two disjoint grams an edit leaves one whole. So of two near words, the one whose prefix ends at the smaller
    rank has a pivot that is in the other's prefix, with everything before it or everything behind it unchanged, and
    shifted by no more than the difference in length. keys_of() has keys that say just that. Candidates are verified.
    """
    pieces = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    counted = sorted((n, gram) for gram, n in words.select(F.explode(pieces).alias("gram")).groupBy("gram").count().collect())
    if len(counted) > MAX_GRAMS:
        raise ValueError(f"more than {MAX_GRAMS} different bigrams: words hold other letters than {RUN}")
    order = {gram: (n, rank) for rank, (n, gram) in enumerate(counted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, chosen = grams_of(word, order)
                for is_pivot, grams in ((True, chosen), (False, head)):
                    out += [(key, word, n, is_pivot, head[-1][1]) for _, _, at in grams for key in keys_of(word, at, is_pivot)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "word", "n", "pivot", "last"])

    found = words.select("word", "n").mapInArrow(run, "key string, word string, n long, pivot boolean, last long")
    index = materialised(found.withColumn("key", F.xxhash64("key")), "grams")  # keys that collide only make candidates
    one = index.where("pivot").select("key", F.col("word").alias("w"), F.col("n").alias("n_w"), F.col("last").alias("end_w"))
    other = index.where("not pivot").select("key", F.col("word").alias("v"), F.col("n").alias("n_v"), F.col("last").alias("end_v"))
    met = one.join(other, "key").where((F.col("end_w") <= F.col("end_v")) & (F.col("w") != F.col("v")) & (F.levenshtein("w", "v", 1) == 1))
    first = F.col("w") < F.col("v")
    return met.select(*(F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in (("a", "w", "v"), ("b", "v", "w"), ("n_a", "n_w", "n_v"), ("n_b", "n_v", "n_w")))).distinct()


def group(words: DataFrame, *, ratio: int = 2) -> DataFrame:
    """Columns word, form, root, n, n_near, form_n: the near word of largest n if that is at least `ratio` (2 or more) times the word's own, and where forms lead to.

    Ties go to the smallest word in code-point order; form and form_n are null where no near word is common enough,
    and root is then the word itself. An empty table gives an empty one. Every step along forms multiplies n by
    `ratio`, so that their number is at most a logarithm of the largest n, and paths are halved in a logarithm of that.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: forms could lead in circles")
    words = materialised(words.select("word", "n"), "words")
    pairs = materialised(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("able", -F.col("best.rank") >= ratio * F.col("n"))
    found = materialised(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("able"), F.col("best.near")).alias("form"), F.when(F.col("able"), -F.col("best.rank")).alias("form_n")), "forms")
    steps = math.log(max(2, words.agg(F.max("n")).first()[0] or 0), ratio)
    ends = found.where("form is not null").select("word", F.col("form").alias("end"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        beyond = ends.select(F.col("word").alias("end"), F.col("end").alias("beyond"))
        ends = materialised(ends.join(beyond, "end", "left").select("word", F.coalesce("beyond", "end").alias("end")), "ends")
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
