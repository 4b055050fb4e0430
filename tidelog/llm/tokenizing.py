"""Whole-text encoding with the tokenizers library, with a bounded cache of pieces.

Word-level BPE encodes the pieces between its pre-tokenizer's cuts independently.  For texts of plain letters, digits
and punctuation, the cuts are found here, by the pattern of the vocabulary file, and the library's model is asked
for each piece that the cache lacks.  Of other texts (special tokens, other scripts, combining marks), the lines
concerned go through the library's whole chain.  Line ends are white space, which the vocabulary drops, so lines
may be encoded one by one.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY, END = "word_bpe_49k.json", 2

#: Text for which NFC changes nothing and lower-casing is by character; the special tokens begin with <|.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*\Z")
_SPECIAL = "<|"
#: The vocabulary file's pattern, as far as plain text goes.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's printable letters: bytes that print stand for themselves, the others follow from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in prints)}


class _Pieces(dict):
    """Piece -> its ids as bytes.  Full: the older half goes, pieces in use come back."""

    def __init__(self, tokenizer: Tokenizer, limit: int):
        super().__init__()
        self.model, self.letters, self.limit, self.old = tokenizer.model, _byte_letters(), limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            ids = b"".join(t.id.to_bytes(4, "little") for t in tokens)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """encode(text): little-endian unsigned 32-bit ids, the end id last.  limit: pieces that each cache half keeps."""

    def __init__(self, path: str, end: int = END, limit: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.end = _Pieces(self.tokenizer, limit), end.to_bytes(4, "little")

    def _plain(self, text: str) -> bytes | None:
        if _SPECIAL not in text and _PLAIN.match(text):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        return None

    def _line(self, line: str) -> bytes:
        ids = self._plain(line)
        if ids is None:
            ids = np.array(self.tokenizer.encode(line, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        ids = self._plain(text)
        return (b"".join(map(self._line, text.split("\n"))) if ids is None else ids) + self.end


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int = END) -> Encoder:
    """One for each Python worker, which outlives its tasks."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def vocabulary(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)
