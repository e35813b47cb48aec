"""Exact token ids of whole texts by a public tokenizer file, with a cache of pieces.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids of the pieces,
put together, are the ids of the text: before white space that follows a visible character, after a
single line feed, and after a word of letters that goes on with `. , ; : ! ? # * $ % &`.  `tests/llm/test_contracts.py` holds this
against the library on whole texts.  Each Python worker keeps the ids of the pieces it has seen, up
to a fixed number.
"""

from __future__ import annotations

import os
import re
from array import array

import pyarrow as pa

#: White space belongs to the piece after it.
SPACED = re.compile(r"\s*\S+|\s+")
#: A word, and what follows it without another letter, digit or space.
TAIL = ".,;:!?#*$%&"
#: White space other than the space and the line feed.
RARE_ASCII = "\t\v\f\r\x1c\x1d\x1e\x1f"
RARE = RARE_ASCII + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces that a worker remembers; beyond that it begins anew.
REMEMBERED = 900_000
_encoders: dict[str, "Encoder"] = {}


#: One pre-token of both kinds of vocabulary, whatever stands around it.
WORD = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")


def is_word(piece: str) -> bool:
    """Whether all of it is a WORD; the pattern is only asked where a character is not ASCII."""
    if piece.isascii():
        return (piece[1:] if piece[:1] == " " else piece).isalpha()
    return WORD.fullmatch(piece) is not None


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies use for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """`ids(texts)` gives each text's ids as little-endian unsigned 32-bit bytes; itself it is the cache of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # a vocabulary whose normalizer lower-cases also drops white space
        self.bare = b'"Lowercase"' in (self.tokenizer.normalizer.__getstate__() if self.tokenizer.normalizer else b"")
        self.letters = byte_letters()

    def pieces(self, text: str) -> list[str]:
        if self.bare:
            if text.isascii() or max(text) < "\u0100":  # one lower-case letter for each, and nothing to compose
                text = text.lower()
            return text.replace("\n", " ").split(" ")
        # single characters are found far faster than patterns; two characters of white space stand together within a line or at its ends
        rare = any(map(text.__contains__, RARE_ASCII if text.isascii() else RARE))
        if rare or "\0" in text or "  " in text or "\n" in text and not all(x and x[0] != " " != x[-1] for x in text.split("\n")):
            return SPACED.findall(text)
        # a line feed with something visible after it is a pre-token of its own
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def __missing__(self, piece: str) -> bytes:
        if not piece:
            found = b""
        elif piece[-1] in TAIL and is_word(word := piece.rstrip(TAIL)):
            found = self[word] + self[piece[len(word) :]]
        elif is_word(piece) and (not self.bare or piece == piece.lower()):
            letters = piece.replace(" ", self.letters[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        else:
            found = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = found
        return found

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Null and empty texts have no ids."""
        out = []
        for text in texts:
            if len(self) > REMEMBERED:
                self.clear()
            out.append(b"".join(map(self.__getitem__, self.pieces(text))) if text else b"")
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; loaded once in each Python process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_lists(found: list[bytes]) -> pa.Array:
    """A list column of unsigned ids, made without a copy for each id."""
    lengths = pa.array([0, *(len(x) // 4 for x in found)], pa.int64()).to_numpy().cumsum()
    values = pa.Array.from_buffers(pa.int32(), int(lengths[-1]), [None, pa.py_buffer(b"".join(found))])
    return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)
