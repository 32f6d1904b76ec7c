"""Whole-text token ids from the ``tokenizers`` library, with a bounded table of pieces.

A byte-level or word BPE never joins what its pre-tokenizer separates, so a text can be cut at
places where the pre-tokenizer surely separates, each distinct piece encoded once by the library
and the results joined.  Pieces are cut only between ASCII or Latin-1 letters, ASCII digits, ASCII
punctuation (apostrophes apart) and white space; anything else goes to the library as a whole
blank-free chunk.  A vocabulary whose pre-tokenizer is unknown gets whole texts.

Defined cases: a null or empty text has no ids; texts of any length are taken whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = 500_000
LONGEST_PIECE = 64

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = "!-&(-/:-@\\[-`{-~"
_BLANK = "\t-\r \x85\xa0  -     　"


def _pieces(lead: str, blank: str, more: str = "") -> re.Pattern[str]:
    return re.compile(
        rf"{lead}[{_LETTER}]+(?=[\t-\r -@\[-`{{-~]|\Z)"
        rf"|{lead}[{_MARK}]+(?=[\t-\r {_LETTER}]|\Z)"
        rf"|{lead}[0-9]+(?=[\t-\r !-/:-@\[-`{{-~{_LETTER}]|\Z)"
        rf"|{lead}[^{blank}]+{more}"
    )


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as it is, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Blanks belong to the pieces: a run of them goes without its last one before a word.
BYTE_PIECES = _pieces(" ?", _BLANK, f"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: Blanks are dropped; only the plain ones are taken as certain separators.
WORD_PIECES = _pieces("", " \t\n\r")


def vocabulary_path(name: str) -> str:
    """A path is itself; a bare file name is looked up among the public tokenizers."""
    return name if "/" in name else public_tokenizers.path(name)


class PieceEncoder(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers.

    Holds ``PIECES`` new pieces and as many of the generation before, so that frequent ones stay.
    """

    def __init__(self, path: str):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("normalizer") or {}).get("type"), (spec.get("pre_tokenizer") or {}).get("type")
        suffix = spec["model"].get("end_of_word_suffix")
        self.pieces = BYTE_PIECES if kind == (None, "ByteLevel") else WORD_PIECES if kind == ("Sequence", "Sequence") and suffix else None
        # a piece of one kind of character is one pre-token, so the library's model can take it at once
        self.lower = self.pieces is WORD_PIECES
        self.model, self.letters = self.library.model, _byte_letters()
        self.whole = re.compile(f"[{_LETTER}]+|[{_MARK}]+" if self.lower else f" ?(?:[{_LETTER}]+|[{_MARK}]+|[0-9]+)").fullmatch

    def encoded(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.pop(piece, None)
        if ids is not None:
            pass
        elif self.lower and piece.isascii() and piece.isalpha():  # letters that byte-level writing leaves as they are
            ids = array("I", [t.id for t in self.model.tokenize(piece.lower())]).tobytes()
        elif self.whole(piece):
            written = (piece.lower() if self.lower else piece).encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        else:
            ids = self.encoded(piece)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def id_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pieces is None:
            return self.encoded(text)
        return b"".join(map(self.__getitem__, self.pieces.findall(text)))


@lru_cache(maxsize=2)
def encoder(name: str) -> PieceEncoder:
    """One encoder a worker process and vocabulary; its pieces stay from task to task."""
    return PieceEncoder(vocabulary_path(name))
