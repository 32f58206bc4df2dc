"""Token counts by rank-synchronous merging of ragged arrays.

Stretches of text are held as one flat array of symbols with a sequence number each. In every round all
sequences apply their own lowest-ranked adjacent pair at the same time; sequences without a pair left are
finished, and the symbols that survive are their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SPACE, Pieces, memo_of, pieces_of, read_model
from .shared import chunks, released

NONE = np.int32(2**31 - 1)
CHUNK_BYTES = 2_000_000
MEMO = 200_000


class RankMerger:
    """Counts the tokens of many stretches at once."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        symbols = list(pieces.id_of)
        symbols += sorted({c for p in symbols for c in p} - set(symbols))
        number = {p: i for i, p in enumerate(symbols)}
        self.width = len(symbols) + 1  # the last number stands for any character that is in no piece
        self.other = len(symbols)
        self.char = {c: i for c, i in number.items() if len(c) == 1}
        self.is_piece = np.array([p in pieces.id_of for p in symbols] + [False])
        # equal scores share a rank; of those, only the leftmost pair is applied in a round
        scores = sorted(set(pieces.score_of.values()), reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        keys, ranks, results = [], [], []
        for p in pieces.id_of:
            for i in range(1, len(p)):
                left, right = number.get(p[:i]), number.get(p[i:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    ranks.append(rank[pieces.score_of[p]])
                    results.append(number[p])
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.results = np.array(results, np.int32)[order]
        seen = np.bincount([rank[s] for s in pieces.score_of.values()], minlength=len(scores))
        self.shared_rank = seen > 1

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting symbol of each pair."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.results[at]

    def count(self, stretches: list[str]) -> list[int]:
        """Tokens of each stretch (spaces stand for word marks)."""
        if not stretches:
            return []
        flat = "".join(stretches).replace(" ", SPACE)
        char, other = self.char, self.other
        symbol = np.array([char.get(c, other) for c in flat], np.int32)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        # a symbol outside the vocabulary costs its UTF-8 bytes
        cost = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF) if self.pieces.byte_fallback else np.ones(len(points), np.int32)
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        seq = np.repeat(np.arange(len(stretches), dtype=np.int32), lengths)
        total = np.zeros(len(stretches), np.int64)
        cost = np.where(self.is_piece[symbol], 1, cost).astype(np.int32)
        rank, result = self._pairs(symbol, seq)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(seq)])
            if (best == NONE).any():
                done = np.repeat(best == NONE, sizes)
                total += np.bincount(seq[done], weights=cost[done], minlength=len(total)).astype(np.int64)
                keep = ~done
                symbol, seq, cost, rank, result = symbol[keep], seq[keep], cost[keep], rank[keep], result[keep]
                starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]]) if len(seq) else starts[:0]
                sizes, best = sizes[best != NONE], best[best != NONE]
                if not len(seq):
                    break
            row = np.repeat(np.arange(len(starts)), sizes)
            hit = np.flatnonzero(rank == best[row])
            single = self.shared_rank[best]
            for _ in range(2):
                chosen = self._apart(hit, row, single)
                merged = self._merge(symbol, seq, cost, rank, result, chosen)
                # a new pair that ranks before the one just applied would have come before its next occurrence
                early = merged[3] < best[np.repeat(np.arange(len(starts)), np.bincount(np.searchsorted(starts, merged[5], "right") - 1, minlength=len(starts)))]
                if not early.any():
                    break
                single = single.copy()
                single[np.unique(np.searchsorted(starts, merged[5][early], "right") - 1)] = True
            symbol, seq, cost, rank, result = merged[:5]
        return total.tolist()

    def _pairs(self, symbol: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, result = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int32)
        rank[:-1], result[:-1] = self.lookup(symbol[:-1], symbol[1:])
        rank[:-1][seq[1:] != seq[:-1]] = NONE
        return rank, result

    @staticmethod
    def _apart(hit: np.ndarray, row: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Of the positions hit, those that don't overlap, from the left; only the first in rows marked single."""
        if single.any():
            r = row[hit]
            hit = hit[~single[r] | np.r_[True, r[1:] != r[:-1]]]
        fresh = np.r_[True, hit[1:] != hit[:-1] + 1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        return hit[(np.arange(len(hit)) - first) % 2 == 0]

    def _merge(self, symbol, seq, cost, rank, result, at):
        """The arrays with the pairs at `at` joined, and each symbol's old position."""
        symbol, cost, rank, result = symbol.copy(), cost.copy(), rank.copy(), result.copy()
        symbol[at], cost[at] = result[at], 1
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        old = np.flatnonzero(keep)
        symbol, seq, cost, rank, result = symbol[old], seq[old], cost[old], rank[old], result[old]
        now = np.searchsorted(old, at)
        touched = np.unique(np.r_[now, now[now > 0] - 1])
        last = touched == len(symbol) - 1
        inner = touched[~last]
        r, s = self.lookup(symbol[inner], symbol[inner + 1])
        r[seq[inner] != seq[inner + 1]] = NONE
        rank[inner], result[inner] = r, s
        rank[touched[last]] = NONE
        return symbol, seq, cost, rank, result, old


_MERGERS: dict[int, RankMerger] = {}


def count_tokens(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """Count the tokens of every text as the library does for a merge-type SentencePiece model.

    Returns id_col, n_bytes (UTF-8), n_tokens (no begin or end id) and over_limit (n_tokens > limit), a row
    for each input row. A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeated; other
    columns are ignored whatever their names; an empty table gives an empty result. Texts are never cut
    short: a long one is one chunk. Strings of control pieces inside a text are plain text.
    """
    model = read_model(model_path)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        merger = _MERGERS.setdefault(id(pieces), None) or RankMerger(pieces)
        _MERGERS[id(pieces)] = merger
        memo, stretches = memo_of(model, "counts", MEMO), pieces.stretches
        for batch in chunks(batches, 1, CHUNK_BYTES):
            texts = [stretches(t or "") for t in batch.column(1).to_pylist()]
            new = memo.missing(set(chain.from_iterable(texts)))
            memo.recent.update(zip(new, merger.count(new), strict=True))
            tokens = [sum(map(memo.recent.__getitem__, words)) for words in texts]
            memo.turn()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = slim.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
