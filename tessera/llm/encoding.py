"""Exact, fast encoding of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

#: A text with white space other than these two is encoded in one go.
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: A line end between two words; letters with the white space before them, if a plain delimiter follows; else all up to the next
#: white space.
_PIECE = re.compile(r"(?<![ \n])\n(?=[^ \n])|[ \n]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n.,#$%&*]|\Z)|[ \n]*[^ \n]+|[ \n]+")
#: The same without white space, for a tokenizer that drops it.
_BARE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n.,#$%&*]|\Z)|[^ \n]+")
_LONGEST_KEPT = 64
#: A piece that is one pre-token, whatever else the tokenizer does: its ids are the model's own.
_PLAIN, _PROBES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch, ["the", " the", "Zebra", " Œuvre", "Élan", " naïve", "ßüñÿÀ", " ÞØÖ", "qzxv", "don"]


def _byte_letters() -> dict[int, str]:
    """How byte-level models spell the characters of _PLAIN: a printable byte as itself, the others as the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in [32, *range(0xC0, 0x100)]}


class _Known(dict):
    """Ids by piece; a new piece's are worked out when it is asked for, and kept if it is short."""

    def __init__(self, ids: Callable[[str], bytes]):
        super().__init__()
        self.ids = ids

    def __missing__(self, piece: str) -> bytes:
        found = self.ids(piece)
        if len(piece) <= _LONGEST_KEPT:
            self[piece] = found
        return found


class Encoder:
    """texts -> token ids, unsigned 32-bit in the machine's (little-endian) order.

    Both kinds of tokenizer here end a pre-token wherever a space or line end follows another character, and between a
    letter and a sign, so the ids of a text are those of its pieces (white space with the word behind it, signs) in turn.
    The ids of short pieces are remembered, at most about `most` of them. A text holding other white space, or the
    spelling of an added token (which the tokenizer makes one id of), is handed to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, _Known(self._ids)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added)).search if added else lambda text: None
        bare, *spaced = self.whole(["a", " a", "a ", "\na"])
        keeps_space = any(x != bare for x in spaced)
        self.pieces = (_PIECE if keeps_space else _BARE).findall
        lower, letters, tokens = self.whole(["Zebra"]) == self.whole(["zebra"]), _byte_letters(), self.tokenizer.model.tokenize
        self.model = lambda piece: array("I", [t.id for t in tokens((piece.lower() if lower else piece).translate(letters))]).tobytes()
        probes = [x for x in _PROBES if _PLAIN(x) and (keeps_space or x[0] != " ")]
        self.direct = all(self.model(x) == y for x, y in zip(probes, self.whole(probes), strict=True))

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _OTHER_SPACE.search(text) or self.added(text):
            return self.whole([text])[0]
        if len(self.known) > self.most:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def _ids(self, piece: str) -> bytes:
        return self.model(piece) if self.direct and _PLAIN(piece) else self.whole([piece])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
