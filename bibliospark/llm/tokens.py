"""Encoding of whole texts with the tokenizers library, remembering the ids of text pieces.

A byte-level BPE never joins text across a single space between two visible characters, so a text may be cut
there; pieces repeat, and their ids are kept in two bounded memories (piece, then word of the piece).
"""

from __future__ import annotations

import array
import os
import re
import sys

import numpy as np
import regex

#: White space other than a space or a line feed.
_OTHER = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The words that the byte-level pre-tokenizer finds (fixed by the vocabulary's format).
_WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_PLAIN = re.compile(r"[\x20-\x7e\n\xa1-\xff]*\Z")
#: Bytes that the byte-level alphabet shows as themselves; the others are 256 and on, in order (fixed by the format).
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_ALPHABET = [_HIDDEN.get(b, chr(b)) for b in range(256)]
_SPACE = _ALPHABET[32]


#: A text on which encoding by words must give what the library gives for the whole.
PROBE = "A probe of words, we'll say: it's 12,345 long!\n\n\tNaïve  漢字 (x) .. end. " * 3


class Memory(dict):
    """Ids by text, computed when missing; the last ``bound`` of them and those before are kept, of short texts only: what is
    long rarely comes again, and would leave the memory without a bound in bytes."""

    LONGEST = 64

    def __init__(self, compute, bound: int):
        self.compute, self.bound, self.old = compute, bound, {}

    def __missing__(self, text: str) -> bytes:
        value = self.old.get(text)
        if value is None:
            value = self.compute(text)
        if len(text) > self.LONGEST:
            return value
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[text] = value
        return value


class Encoder:
    """Encodes texts; ``width`` is the bytes an id needs. Equal to the library's own encoding of the whole text."""

    PIECES, WORDS = 250_000, 400_000

    def __init__(self, path: str, remembered: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.cuts = kind == "ByteLevel" and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):  # words are remembered here, once
            self.model._resize_cache(0)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.code = array.array("H" if self.width == 2 else "I").typecode
        self.pieces = Memory(self._piece, remembered or self.PIECES)
        self.words = Memory(self._word, remembered or self.WORDS)
        self.cuts = self.cuts and self.packed([PROBE]) == [self._whole(PROBE)]  # else a setting that the cuts do not know

    def _packed(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.type).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """A word of the pre-tokenizer, given to the library's model in the byte-level alphabet."""
        if word.isascii() and word.isprintable():
            shown = word.replace(" ", _SPACE)
        else:
            shown = "".join(map(_ALPHABET.__getitem__, word.encode()))
        return self._packed([t.id for t in self.model.tokenize(shown)])

    def _piece(self, piece: str) -> bytes:
        """Ids of a space and the piece."""
        if piece.isascii() or _PLAIN.match(piece):
            if piece.isalpha():
                return self.words[" " + piece]
            if piece[-1:] in (".", ",") and piece[:-1].isalpha():
                return self.words[" " + piece[:-1]] + self.words[piece[-1]]
        return self._text(" " + piece)

    def _text(self, text: str) -> bytes:
        if not _PLAIN.match(text) or any(a in text for a in self.added):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))

    def packed(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, in ``width`` bytes an id."""
        if not self.cuts:
            return [self._whole(t) for t in texts]
        out, get = [], self.pieces.__getitem__
        for t in texts:
            odd = "  " in t or " \n" in t or "\n " in t or t[:1] == " " or t[-1:] == " " or _OTHER.search(t)
            parts = _CUT.split(t) if odd else t.split(" ")
            out.append(self._text(parts[0]) + b"".join(map(get, parts[1:])))
        return out


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """One encoder a worker process, path and number of texts that it remembers."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]
