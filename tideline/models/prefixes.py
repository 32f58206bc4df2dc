"""Counts over growing prefixes of rows: those of each block between two ends, added up from the first.

A row is read once, however many prefixes it is in. Ends are given in ascending order; a prefix has the rows with a
row_index below its end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.temporal import cut


@dataclass(frozen=True)
class Known:
    """What training rows say: rows by label, the terms in use, and how many texts have each."""

    labels: dict[str, int]
    terms: list[str]
    texts: list[int]

    @property
    def rows(self) -> int:
        return sum(self.labels.values())

    @property
    def idf(self) -> list[float]:
        """As Spark ML's IDF weighs terms."""
        return [math.log((self.rows + 1) / (n + 1)) for n in self.texts]


def blocked(rows: DataFrame, ends: list[int]) -> DataFrame:
    """Adds _block, the first prefix a row is in; rows in none go."""
    passed = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= F.col("row_index")))
    return rows.where(F.col("row_index") < ends[-1]).withColumn("_block", passed)


def label_prefixes(rows: DataFrame, label: str, ends: list[int]) -> list[dict[str, int]]:
    """Rows of each label in each prefix. There are few labels: as many as a classifier has classes."""
    counts = blocked(rows.select("row_index", F.col(label).cast("string").alias("_label")), ends).groupBy("_block", "_label").agg(F.count("*").alias("n"))
    found = [{} for _ in ends]
    for r in counts.orderBy("_label").collect():
        for k in range(r["_block"], len(ends)):
            found[k][r["_label"]] = found[k].get(r["_label"], 0) + r["n"]
    return found


def term_prefixes(rows: DataFrame, grams: str, ends: list[int], features: int) -> list[list[str]]:
    """For each prefix its most frequent terms (ties: the smaller one first).

    Terms are counted for all prefixes at once, before they move; every prefix then takes the best of each task's rows,
    without a sort of all. What reaches the driver is what the models hold.
    """
    each = blocked(rows.select("row_index", grams), ends).select("_block", F.explode(grams).alias("term"))
    uses = cut(each.groupBy("term").agg(*(F.count_if(F.col("_block") <= k).alias(f"_uses_{k}") for k in range(len(ends)))))
    best = [uses.where(F.col(f"_uses_{k}") > 0).select(F.lit(k).alias("prefix"), F.col(f"_uses_{k}").alias("uses"), "term").orderBy(F.desc("uses"), "term").limit(features) for k in range(len(ends))]
    found = [[] for _ in ends]
    for r in sorted(reduce(DataFrame.unionByName, best).collect(), key=lambda r: (-r["uses"], r["term"])):
        found[r["prefix"]].append(r["term"])
    return found


def text_prefixes(rows: DataFrame, counts: str, terms: list[str], ends: list[int]) -> list[dict[str, int]]:
    """For each prefix how many rows have each of the terms, whose counts are a vector."""
    blocks = blocked(rows.select("row_index", counts), ends).groupBy("_block").agg(Summarizer.numNonZeros(F.col(counts)).alias("n"))
    found = [dict.fromkeys(terms, 0) for _ in ends]
    for r in blocks.collect():
        for term, n in zip(terms, r["n"].toArray(), strict=True):
            for k in range(r["_block"], len(ends)):
                found[k][term] += int(n)
    return found
