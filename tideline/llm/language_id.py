"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted
(rotated) by its distance from the end; a text's vector bundles (adds) the vectors of all its n-grams, and
a language's prototype bundles those of its labelled texts. A text belongs to the prototype with the largest
cosine. Sums are of whole numbers, so that results don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantiles import quantiles
from .shared import packed, released, unpacked

CODES = 0x110000
MASK = (1 << 21) - 1
TABLE = 1 << 21
GRAMS_AT_ONCE = 20_000
DIMENSIONS = 512
SEED = 20_113
SLICE = 1_000_000
GROUP_GRAMS = 300_000
GROUP_TEXTS = 64
MAX_LANGUAGES = 10_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """For every code point the letter it is, as the code point of its lower case; 0 for what is no letter."""
    table = np.zeros(CODES, np.int64)
    for i in range(CODES):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def letter_vectors(letters: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """A random vector of +1 and -1 for each letter, of its own: its bits are mixed from code point, place and seed. The mark of a word's edge (0) has one too."""
    words = -(-dimensions // 64)
    x = (letters.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(letters), -1), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Bound vectors of trigrams, given as three code points of 21 bits each."""
    letters, number = np.unique(np.concatenate([grams >> 42, grams >> 21 & MASK, grams & MASK]), return_inverse=True)
    vectors = letter_vectors(letters, dimensions, seed)
    one, two, three = np.split(number, 3)
    return np.roll(vectors, 2, axis=1)[one] * np.roll(vectors, 1, axis=1)[two] * vectors[three]


def trigrams(text: str | None) -> np.ndarray:
    """The trigrams of a whole text; runs of other characters are one mark, and none is a gram's middle."""
    if not text:
        return np.zeros(0, np.int64)
    table = _letter_table()
    parts = [table[np.frombuffer(text[i : i + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)] for i in range(0, len(text), SLICE)]
    s = np.concatenate([np.zeros(1, np.int64), *parts, np.zeros(1, np.int64)])
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
    if len(s) < 3:
        return np.zeros(0, np.int64)
    return (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[s[1:-1] != 0]


def numbered_grams(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, and the number of each gram among them: by a table where the text has few letters, else by sorting."""
    parts = (flat >> 42, flat >> 21 & MASK, flat & MASK)
    met = np.zeros(CODES, bool)
    for x in parts:
        met[x] = True
    letters = np.flatnonzero(met)
    n = len(letters)
    if n**3 > TABLE:
        return np.unique(flat, return_inverse=True)
    dense = np.zeros(CODES, np.int32)
    dense[letters] = np.arange(n)
    key = (dense[parts[0]] * n + dense[parts[1]]) * n + dense[parts[2]]
    used = np.flatnonzero(np.bincount(key, minlength=1))
    place = np.zeros(n**3, np.int32)
    place[used] = np.arange(len(used))
    return letters[used // n**2] << 42 | letters[used // n % n] << 21 | letters[used % n], place[key]


def bundle(grams: list[np.ndarray], rows: np.ndarray, n: int, dimensions: int, seed: int) -> np.ndarray:
    """Sum of the vectors of the grams of each row: n x dimensions."""
    flat = np.concatenate(grams)
    if not len(flat):
        return np.zeros((n, dimensions))
    used, number = numbered_grams(flat)
    row, out = np.repeat(rows, [len(g) for g in grams]), np.zeros((n, dimensions))
    for at in range(0, len(used), GRAMS_AT_ONCE):
        part = used[at : at + GRAMS_AT_ONCE]
        r, k = (row, number) if len(used) <= GRAMS_AT_ONCE else (x[(number >= at) & (number < at + len(part))] for x in (row, number))
        counts = np.bincount(r.astype(np.int64) * len(part) + (k - at), minlength=n * len(part)).reshape(n, len(part))
        exact = np.float32 if counts.sum(axis=1).max() < 2**24 else np.float64
        out += counts.astype(exact) @ gram_vectors(part, dimensions, seed).astype(exact)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows with the grams of their texts (column `text`), of a bounded size if no single text exceeds it."""
    for batch in batches:
        grams, total, start = [], 0, 0
        for i, text in enumerate(batch.column("text")):
            grams.append(trigrams(text.as_py()))
            total += len(grams[-1])
            if total >= GROUP_GRAMS or len(grams) >= GROUP_TEXTS or i == batch.num_rows - 1:
                yield batch.slice(start, len(grams)), grams
                grams, total, start = [], 0, i + 1


def fit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes of all languages from all rows of df; rows with a null label or text are left out.

    Tasks bundle their own rows; sums by language and dimension come from a grouped aggregate. The driver
    gets one vector for each language (MAX_LANGUAGES at most, else ValueError), whatever the number of rows.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for group, grams in _groups(batches):
            langs = group.column("lang").to_pylist()
            names = sorted(set(langs))
            rows = np.array([names.index(x) for x in langs])
            for name, v in zip(names, bundle(grams, rows, len(names), dimensions, seed), strict=True):
                sums[name] = sums.get(name, 0) + v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(whole) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = {r["lang"]: np.array([x["x"] for x in r["v"]], float) for r in whole}
    return {k: found[k] for k in sorted(found) if found[k].any()}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", carry: list[str], seed: int = SEED) -> DataFrame:
    """Language of every text: the columns in `carry` as they are, lang_pred and score (the cosine, not below 0), a row for each input row.

    A text that is null or without a letter gets `und` and 0, as does every text if nothing was learned; equal
    cosines go to the language that sorts first. Carried columns may hold nulls and repeats, other columns are
    ignored, and an empty table gives no rows.
    """
    names = list(prototypes)
    unit = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, grams in _groups(batches):
            n = len(grams)
            known = np.array([len(g) > 0 for g in grams]) & bool(names)
            langs, scores = [UNKNOWN] * n, np.zeros(n)
            if known.any():
                v = bundle(grams, np.arange(n), n, unit.shape[1], seed)[known]
                cosine = (v @ unit.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                best = np.argmax(np.round(cosine, 12), axis=1)
                scores[known] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                for i, b in zip(np.flatnonzero(known), best, strict=True):
                    langs[i] = names[b]
            yield pa.RecordBatch.from_arrays([group.column("rest"), pa.array(langs), pa.array(scores)], names=["rest", "lang_pred", "score"])

    slim = df.select(packed(carry).alias("rest"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["rest"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return slim.mapInArrow(run, schema).select(*unpacked(carry), "lang_pred", "score")


def held_out(column: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 on division by 3 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


#: For threshold(): texts of fewer code points are too short to be told from junk by their score.
LEAST_CHARS = 50


def threshold(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text: str = "text", label: str = "lang", share: float = 0.001, margin: float = 0.6) -> float:
    """The score under which a text of LEAST_CHARS code points or more is like none of the languages; 0 without labelled texts.

    It is `margin` times the score that all but `share` of the labelled texts reach whose language is predicted. All
    labelled texts are scored, and the quantile of their scores is exact; only scores are kept and sorted, in ranges.
    """
    rows = docs.where(F.col(label).isNotNull() & (F.char_length(text) >= LEAST_CHARS)).select(text, label)
    found = predict(rows, prototypes, text_col=text, carry=[label]).where(F.col("lang_pred") == F.col(label))
    least = quantiles(found.select(F.lit(0).alias("all"), "score"), "all", "score", {"least": share}).first()
    return margin * (least["least"] if least else 0.0)
