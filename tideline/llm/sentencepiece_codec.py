"""SentencePiece encoding and decoding for merge-type vocabularies with a score-ordered agenda.

All adjacent symbol pairs of a stretch stand in one agenda, best score first and leftmost first among equals.
The best valid pair is merged and its two new neighbours are entered. A process encodes a stretch when it
first meets it, and checks it there against the library; of every batch, one whole text is checked too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, repeat
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import SPACE, Pieces, memo_of, pieces_of, read_model
from .shared import chunks, released

CHUNK_BYTES = 2_000_000
MEMO = 400_000
LONG = 64  # longer stretches seldom come again and aren't remembered
SHORT = 48  # symbols up to which the agenda is a list
PLACE = (1 << 40) - 1
NO_PAIR = 1 << 40


def agenda_encode(stretch: str, pieces: Pieces) -> list[int]:
    """Ids of one stretch (spaces stand for word marks)."""
    symbols = list(stretch.replace(" ", SPACE))
    if len(symbols) > 1:
        (_merge_short if len(symbols) <= SHORT else _merge_long)(symbols, pieces.rank_of.get)
    out, id_of = [], pieces.id_of.get
    for s in symbols:
        if s is not None:
            if (i := id_of(s)) is not None:
                out.append(i)
            elif pieces.byte_fallback or not out or out[-1] != pieces.unknown:
                out += pieces.fallback(s)
    return out


def _merge_short(symbols: list[str], rank: Callable) -> None:
    """Merges in place, with an agenda that has an entry for each place: its least is searched for, the leftmost of equals."""
    agenda = list(map(rank, map(add, symbols, symbols[1:]), repeat(NO_PAIR)))
    while agenda and (best := min(agenda)) != NO_PAIR:
        i = agenda.index(best)
        piece = symbols[i] + symbols.pop(i + 1)
        symbols[i] = piece
        del agenda[i]
        if i:
            agenda[i - 1] = rank(symbols[i - 1] + piece, NO_PAIR)
        if i < len(agenda):
            agenda[i] = rank(piece + symbols[i + 1], NO_PAIR)


def _merge_long(symbols: list[str | None], rank: Callable) -> None:
    """As _merge_short(), with a heap as agenda; merged symbols leave a None behind."""
    # an entry is the rank of a pair's score and, below it, the place of the left symbol; current has each place's latest
    n = len(symbols)
    current = [-1 if r is None else r << 40 | i for i, r in enumerate(map(rank, map(add, symbols, symbols[1:])))]
    current.append(-1)
    agenda = [entry for entry in current if entry >= 0]
    heapify(agenda)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while agenda:
        entry = heappop(agenda)
        i = entry & PLACE
        if current[i] != entry:
            continue  # one of the two has been merged since
        j = after[i]
        symbols[i] = piece = symbols[i] + symbols[j]
        symbols[j], current[i], current[j] = None, -1, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(piece + symbols[k])) is not None:
                current[i] = entry = r << 40 | i
                heappush(agenda, entry)
        h = before[i]
        if h >= 0:
            r = rank(symbols[h] + piece)
            current[h] = -1 if r is None else r << 40 | h
            if r is not None:
                heappush(agenda, current[h])


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, end_id: bool = True) -> DataFrame:
    """Encode every text and decode it again with the library's decode(ids).

    Returns id_col, ids (array<int>, with the end id last if asked for), decoded (string) and checked (boolean:
    the library gave the same ids for every stretch when this process first met it, and for the whole text in
    one row of every batch; where it doesn't, the row has the agenda's ids and checked is false). A null text counts as empty. Ids may be null or
    repeated; other columns are ignored whatever their names; an empty table gives an empty result. Texts
    are never cut short.
    """
    kind = df.schema[id_col].dataType
    fields = [T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("checked", T.BooleanType())]
    out = _run(df, id_col, text_col, model_path, end_id, T.StructType(fields), digest=False)
    return out.withColumnRenamed("id", id_col)


def encode_digest(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, end_id: bool = True) -> DataFrame:
    """As encode(), with n_tokens, ids_sha256, decoded_sha256 and checked: digests are taken in the same pass, so that ids don't leave the task."""
    kind = df.schema[id_col].dataType
    fields = [T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("checked", T.BooleanType())]
    out = _run(df, id_col, text_col, model_path, end_id, T.StructType(fields), digest=True)
    return out.withColumnRenamed("id", id_col)


def _run(df: DataFrame, id_col: str, text_col: str, model_path: str | None, end_id: bool, schema: T.StructType, digest: bool) -> DataFrame:
    model = read_model(model_path)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, library = pieces_of(model), _plain(model)
        whole, decode, stretches = pieces.processor.encode, pieces.processor.decode, pieces.stretches
        last = [pieces.end] if end_id else []
        written = list(map(str, range(pieces.processor.get_piece_size()))).__getitem__
        memo, wrong = memo_of(model, "ids", MEMO), _wrong(model)
        for batch in chunks(batches, 1, CHUNK_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cut = list(map(stretches, texts))
            new = memo.missing(set(chain.from_iterable(cut)))
            own = [tuple(agenda_encode(w, pieces)) for w in new]
            wrong.update(w for w, a, b in zip(new, own, library.encode(new, num_threads=1) if new else [], strict=True) if a != tuple(b))
            long = {}
            for w, x in zip(new, own, strict=True):
                (memo.recent if len(w) <= LONG else long)[w] = x
            of = memo.recent.__getitem__ if not long else lambda w, long=long: long[w] if len(w) > LONG else memo.recent[w]
            ids = [list(chain.from_iterable(map(of, words))) for words in cut]
            right = [not (wrong and any(w in wrong for w in words)) for words in cut]
            if texts:
                right[0] = right[0] and whole(texts[0]) == ids[0]
            memo.turn()
            for x in ids:
                x += last
            text = [decode(x) for x in ids]
            if digest:
                columns = [pa.array(map(len, ids), pa.int64()), pa.array([_sha(" ".join(map(written, x))) for x in ids]), pa.array(map(_sha, text))]
            else:
                columns = [pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(right, pa.bool_())], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@lru_cache(maxsize=4)
def _wrong(model: bytes) -> set[str]:
    """Stretches of which the library gave other ids, for as long as the process remembers the agenda's."""
    return set()


@lru_cache(maxsize=4)
def _plain(model: bytes):
    """The library without the space that it puts before a text: stretches have theirs already."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    proto.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
