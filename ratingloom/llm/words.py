"""Words of whole texts as 64-bit numbers, computed for many texts at once.

A word is a run of bytes other than the six ASCII white-space characters.  Its
number depends on its bytes alone, so it is the same in every task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=_U)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts are joined up to this many bytes before the array work.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (an invertible map)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    done, step = 1, _U(base)
    while done < n:
        take = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + take] = out[:take] * step
            step = step * step
        done += take
    return out


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 .. n-1, modulo 2**64."""
    if n > 2 * CHUNK_BYTES:
        return _powers(base, n)  # one very long text; not kept
    if base not in _POWERS:
        _POWERS[base] = _powers(base, 2 * CHUNK_BYTES)
    return _POWERS[base][:n]


class Chunk:
    """Several texts' bytes with the place and number of every word."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        sizes = np.array([len(t) + 1 for t in texts])
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.raw = data
        if lower:
            data = _LOWER[data]
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        n = len(data)
        running = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[data] * powers(_BASE, n), out=running[1:])
        self.hashed = mix((running[self.ends] - running[self.starts]) * powers(_UNBASE, n)[self.starts])
        #: Where each text begins in the bytes, with the end.
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        #: How many words each text has.
        self.counts = np.diff(np.searchsorted(self.starts, self.bounds))


def as_bytes(text: str | None) -> bytes:
    """A text's bytes; a null text is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def chunked(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Texts in their order, in lists of about :data:`CHUNK_BYTES`."""
    block: list[bytes] = []
    size = 0
    for text in texts:
        raw = as_bytes(text)
        block.append(raw)
        size += len(raw) + 1
        if size >= CHUNK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def word_arrays(texts: Iterable[str | None], lower: bool) -> Iterator[np.ndarray]:
    """For each text its words' numbers; a null text has none."""
    for block in chunked(texts):
        chunk = Chunk(block, lower)
        at = 0
        for n in chunk.counts.tolist():
            yield chunk.hashed[at : at + n]
            at += n


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the runs of ``n`` words; one for the whole text if it is shorter."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    last = len(words) - n + 1
    total = words[:last].copy()
    for k in range(1, n):
        total = mix(total) + words[k : k + last]
    return mix(total + _U(n))


class Runs:
    """Numbers of arbitrary runs of one text's words."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self._sum = np.zeros(n + 1, _U)
        np.cumsum(words * powers(_BASE, n), out=self._sum[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """The numbers of the runs of ``length`` words from each start."""
        return mix((self._sum[starts + length] - self._sum[starts]) * powers(_UNBASE, len(self._sum))[starts])


def fingerprint(numbers: np.ndarray) -> bytes:
    """128 bits that stand for a sequence of numbers."""
    return hashlib.blake2b(np.ascontiguousarray(numbers).tobytes(), digest_size=16).digest()
