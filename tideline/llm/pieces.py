"""Merge-type SentencePiece vocabularies: pieces, scores, and the cut of a text into independent stretches."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable
from functools import lru_cache

import sentencepiece

SPACE = "▁"


class Pieces:
    """What the merge algorithms need of a model: ids, scores, and which characters can ever be merged.

    A merge joins two adjacent symbols if their concatenation is a normal piece. A text can therefore be
    cut wherever no piece crosses: before a run of spaces that follows another character (if no piece has
    a space mark after another character), around characters that are in no piece of two or more, and
    between a letter and punctuation that no piece has side by side.
    """

    def __init__(self, model: bytes):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        require_supported(model)
        ids = range(sp.get_piece_size())
        normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in normal}
        self.score_of = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        order = {s: i for i, s in enumerate(sorted(set(self.score_of.values()), reverse=True))}
        self.rank_of = {p: order[s] for p, s in self.score_of.items()}  # equal scores share a rank
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.byte_fallback = all(sp.is_byte(i) for i in self.byte_ids)
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        loose = [c for c in "\n\t\r" if not any(len(p) > 1 and c in p for p in self.id_of)]
        if crossing:
            self.cut = re.compile(r".+", re.S)
        else:
            # a space is a word mark here: texts are cut before the marks are put in
            own = "".join(map(re.escape, loose))
            # letters end a stretch where punctuation follows that no piece has after or before a letter
            pairs = {(x, y) for p in self.id_of for x, y in zip(p, p[1:], strict=False)}
            marks = [q for q in string.punctuation if not any((x, q) in pairs or (q, x) in pairs for x in string.ascii_letters)]
            odd = {x for pair in pairs for x in pair if x.isalpha() or x.isalnum()} & {x for q in marks for pair in pairs if q in pair for x in pair}
            letters = rf"[^\W\d_{''.join(map(re.escape, sorted(odd)))}]"
            end = rf"(?=[{''.join(map(re.escape, marks))}])" if marks else "(?!)"
            self.cut = re.compile(rf" *{letters}+(?:{end}|[^ {own}]*)| *[^ {own}]+| +" + (rf"|[{own}]" if own else ""), re.S)

    def stretches(self, text: str) -> list[str]:
        """The independent stretches of a text, with the leading space that the model's normaliser adds.

        Spaces stand for the model's word marks. An empty text has none.
        """
        return self.cut.findall(" " + text.replace(SPACE, " ")) if text else []

    def fallback(self, symbol: str) -> list[int]:
        """Ids of a symbol that is no piece: its UTF-8 bytes, or the unknown id where the model has no bytes."""
        return [self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")] if self.byte_fallback else [self.unknown]


def require_supported(model: bytes) -> None:
    """ValueError unless the model is of the kind that the cuts and merges here are right for."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    normal, trained = proto.normalizer_spec, proto.trainer_spec
    faults = {
        "its model type isn't BPE": trained.model_type != trained.BPE,
        "it normalises characters": bool(normal.precompiled_charsmap),
        "it puts no space before a text": not normal.add_dummy_prefix,
        "it drops repeated spaces": normal.remove_extra_whitespaces,
        "it doesn't escape spaces": not normal.escape_whitespaces,
        "its word marks are suffixes": trained.treat_whitespace_as_suffix,
        "it has user-defined pieces": any(p.type == p.USER_DEFINED for p in proto.pieces),
    }
    found = [what for what, wrong in faults.items() if wrong]
    if found:
        raise ValueError("unsupported SentencePiece model: " + ", ".join(found))


_LOADED: dict[bytes, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    """One instance per Python process and model."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def default_model() -> str:
    """Path of the public 32k merge vocabulary; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str | None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


class Memo:
    """Results by stretch of text in two generations: what was asked for since the last turn stays, the rest goes.

    `recent` and `older` hold up to `limit` stretches each. Results never depend on what is remembered.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.recent: dict = {}
        self.older: dict = {}

    def missing(self, stretches: Iterable[str]) -> list[str]:
        """Which of some distinct stretches are unknown; those of the older generation become recent."""
        recent, older, out = self.recent, self.older, []
        for s in stretches:
            if s not in recent:
                known = older.get(s)
                if known is None:
                    out.append(s)
                else:
                    recent[s] = known
        return out

    def turn(self) -> None:
        if len(self.recent) > self.limit:
            self.older, self.recent = self.recent, {}


@lru_cache(maxsize=4)
def memo_of(model: bytes, use: str, limit: int) -> Memo:
    """One memo for each Python process, model and use: tasks that a worker runs one after the other share it."""
    return Memo(limit)
