"""Token ids of whole texts with the public word-piece vocabulary.

The library's own pipeline costs several microseconds a word.  Its pieces (runs
of letters, single digits, runs of other characters) are tokenised one by one and
do not depend on their neighbours, and no piece holds white space, so each worker keeps a
bounded table of the words it has met and of the pieces of those that have several.  Texts with
characters outside Latin-1, control characters or special tokens go through the library as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Pieces that a worker remembers, and words of several pieces.
CACHE_PIECES, CACHE_WORDS = 300_000, 100_000
# What the vocabulary's file states as its splitting pattern, for Latin-1.
_PIECE = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
# The usual byte alphabet: printable bytes stand for themselves, others follow from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_CHARS = {**{b: chr(b) for b in _PRINTABLE}, **{b: chr(256 + k) for k, b in enumerate(_REST)}}
_LOADED: dict[str, Encoder] = {}


def vocabulary_path() -> str:
    """Where the vocabulary's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Pieces(dict):
    """Word or piece to its ids as little-endian 32-bit bytes."""

    def __init__(self, model) -> None:
        super().__init__()
        self._model = model
        self._words = 0

    def __missing__(self, word: str) -> bytes:
        pieces = () if word.isascii() and word.isalpha() else _PIECE.findall(word)
        if len(pieces) > 1:
            ids = b"".join(map(self.__getitem__, pieces))
            if self._words < CACHE_WORDS:
                self._words += 1
                self[word] = ids
            return ids
        seen = word if word.isascii() else "".join(_BYTE_CHARS[b] for b in word.encode())
        ids = array("I", [t.id for t in self._model.tokenize(seen)]).tobytes()
        if len(self) - self._words < CACHE_PIECES:
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path or vocabulary_path())
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._pieces = _Pieces(self._whole.model)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text; none for a null text."""
        if not isinstance(text, str):
            return b""
        if _PLAIN.fullmatch(text) and not any(s in text for s in self._special):
            return b"".join(map(self._pieces.__getitem__, text.lower().split()))
        ids = self._whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder."""
    key = path or ""
    if key not in _LOADED:
        _LOADED[key] = Encoder(path)
    return _LOADED[key]


def forget() -> None:
    """Let this worker's encoders go: workers outlive the stage that tokenises."""
    _LOADED.clear()
