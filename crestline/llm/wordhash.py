"""Words of whole texts as 64-bit hashes, worked out for many texts at once.

A word is a run of ASCII letters, digits, underscores and characters outside ASCII, in lower case; typographic
punctuation counts as a space.  The hash of a word is a polynomial over its bytes, read off a running sum.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

#: Bytes that are worked on at once; a longer text is cut at white space.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TYPOGRAPHIC = re.compile("[\u0080-©«-´¶-¹»-¿×÷ -⁯　-〿]")
_IS_WORD = np.zeros(256, np.int8)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz_", *range(128, 256)]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


@cache
def word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of word hashes and of its inverse."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _hashes(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte position of every word of ``line``."""
    size = 1 << max(12, (len(line)).bit_length())
    up, down = word_powers(size)
    data = np.frombuffer(line, np.uint8)
    edge = np.diff(_IS_WORD[data], prepend=0, append=0)
    start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start]), start


def lowered(text: str | None) -> bytes:
    low = (text or "").lower()
    return (low if low.isascii() else _TYPOGRAPHIC.sub(" ", low)).encode("utf-8", "replace")


def _parts(line: bytes) -> list[bytes]:
    if len(line) <= CHUNK:
        return [line]
    out, at = [], 0
    while len(line) - at > CHUNK:
        cut = max(line.rfind(b" ", at, at + CHUNK), line.rfind(b"\n", at, at + CHUNK))
        if cut <= at:  # a single run: go on to its end
            ends = [x for x in (line.find(b" ", at + CHUNK), line.find(b"\n", at + CHUNK)) if x >= 0]
            cut = min(ends, default=len(line))
        out.append(line[at:cut])
        at = cut
    return [*out, line[at:]]


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, bounds): the words of text k are ``hashes[bounds[k]:bounds[k + 1]]``."""
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    some: list[bytes] = []
    own: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if some:
            hashes, start = _hashes(b"\n".join(some))
            ends = np.cumsum([len(s) + 1 for s in some])
            np.add.at(counts, own, np.diff(np.searchsorted(start, ends, side="left"), prepend=0))
            found.append(hashes)
        some.clear()
        own.clear()
        held = 0

    for k, text in enumerate(texts):
        for part in _parts(lowered(text)):
            if held + len(part) > CHUNK:
                flush()
            some.append(part)
            own.append(k)
            held += len(part) + 1
    flush()
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])
