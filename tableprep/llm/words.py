"""White-space separated words of a text as 64-bit hashes, in numpy.

A-Z are lower-cased, nothing else; words are ``[^\\x20\\x09-\\x0D]+``.  All words of
a piece are hashed together, eight bytes a step, so that no word becomes a Python
object; short texts are hashed many at a time.  Long texts are hashed a piece at a time: what is held is the piece and 8
bytes a word.  ``Hasher`` gives hashes of any ranges of bytes, as a polynomial over
them (a random number for each byte value) read off a running sum.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20
TOGETHER = 1 << 18
GAP = re.compile(rb"[\x20\x09-\x0D]")
BASE = 0xD6E8FEB86659FD93  # odd


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(POWERS[0]) >= n:
        return POWERS
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        up = np.cumprod(np.concatenate([one, np.full(n - 1, BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([one, np.full(n - 1, pow(BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    POWERS[:] = [up, down]
    return POWERS


SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
GAPS = SPACE.astype(np.uint8).tobytes()
CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
POWERS = [np.zeros(0, np.uint64)] * 2  # grown as longer pieces come


class Hasher:
    """Hashes of any ranges of one piece of bytes, from one running sum."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        n = len(self.bytes)
        self.up, down = _powers(1 << max(16, (n + 1).bit_length()))
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum(CODES[self.bytes] * down[:n], out=self.run[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.run[ends] - self.run[starts]) * self.up[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word."""
        gap = np.ones(len(self.bytes) + 2, bool)
        gap[1:-1] = SPACE[self.bytes]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        return edge[::2], edge[1::2]


LONG = 1024  # bytes; longer words are hashed one by one


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The start and a hash of each word: its length and then its bytes, eight at a time, each step
    through ``mix``.  Words of one length up to eight bytes never collide, and the hash is no
    polynomial, whose collisions can be built."""
    piece = np.frombuffer(data + bytes(8), np.uint8)
    gap = np.ones(len(data) + 2, np.uint8)
    gap[1:-1] = np.frombuffer(data.translate(GAPS), np.uint8)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    eight = np.ndarray(len(data) + 1, "<u8", piece, strides=(1,))
    left = ends - starts
    long = np.flatnonzero(left > LONG)
    with np.errstate(over="ignore"):
        out = mix(left.astype(np.uint64) * np.uint64(BASE))
        who = np.flatnonzero(left <= LONG)
        at, rest = starts[who], left[who]
        while len(who):
            load = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(rest, 8)).astype(np.uint64)))
            out[who] = mix((out[who] ^ load) * np.uint64(BASE) + np.uint64(1))
            more = np.flatnonzero(rest > 8)
            who, at, rest = who[more], at[more] + 8, rest[more] - 8
    for i in long:
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return starts, out


def word_hashes(text: str | None) -> np.ndarray:
    """One uint64 for each word of the whole text, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    data, parts, at = text.encode("utf-8", "replace").lower(), [], 0
    while at < len(data):
        cut = GAP.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        parts.append(_hash_words(data[at:end])[1])
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def word_hashes_each(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """``word_hashes`` of each text; short texts are hashed ``TOGETHER`` bytes at a time."""

    def hashed(held: list[bytes]) -> Iterator[np.ndarray]:
        starts, hashes = _hash_words(b" ".join(held).lower())
        lo = 0
        for hi in np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held])).tolist():
            yield hashes[lo:hi]
            lo = hi

    held, n = [], 0
    for text in texts:
        if text and len(text) > TOGETHER:
            if held:
                yield from hashed(held)
            yield word_hashes(text)
            held, n = [], 0
            continue
        held.append((text or "").encode("utf-8", "replace"))
        n += len(held[-1])
        if n > TOGETHER:
            yield from hashed(held)
            held, n = [], 0
    if held:
        yield from hashed(held)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct ``size``-word shingles; a shorter sequence is one; none of no words."""
    n = len(words)
    with np.errstate(over="ignore"):
        if n == 0:
            return words
        width = min(n, size)
        total = np.full(n - width + 1, (size - width) * 0x632BE59BD9B4E019 & (1 << 64) - 1, np.uint64)
        for j in range(width):
            total += words[j:n - width + 1 + j] * np.uint64((2 * j + 3) * 0x9FB21C651E98DF25 & (1 << 64) - 1 | 1)
        total = mix(total)
        total.sort()
        return total[np.concatenate([[True], total[1:] != total[:-1]])]
