"""Word and shingle hashes of whole texts in numpy; blocks bound the memory of long texts."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[32] = 0
_BASE = 0x9E3779B97F4A7C15
#: A-Z to a-z and the white space bytes 9-13 to a blank, as the word rule asks.
_FOLD = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Bytes hashed at once; a longer word makes a longer block.
BLOCK = 1 << 16
_up = np.empty(0, np.uint64)
_down = np.empty(0, np.uint64)


def _powers(n: int) -> None:
    global _up, _down
    if len(_up) < n:
        n = max(n, BLOCK)
        _up = np.cumprod(np.full(n, _BASE, np.uint64))
        _down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; distinct inputs stay distinct."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(b: np.ndarray) -> np.ndarray:
    """A word's hash is its bytes' values times powers of a base, summed from the word's start."""
    inside = b != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    if inside[-1]:
        edges = np.concatenate([edges, [len(b)]])
    starts, ends = edges[0::2], edges[1::2]
    _powers(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _up[: len(b)])])
    return mix((sums[ends] - sums[starts]) * _down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    folded = text.translate(_FOLD)
    out, at, n = [], 0, len(folded)
    while at < n:
        end = at + BLOCK
        if end < n:
            cut = folded.rfind(b" ", at, end)
            cut = cut if cut > at else folded.find(b" ", end)
            end = cut if cut >= 0 else n
        out.append(_block(np.frombuffer(folded, np.uint8, min(end, n) - at, at)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; fewer words make one run, none none."""
    if not len(words):
        return words
    n = len(words)
    width = min(k, n)
    acc = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[j : n - width + 1 + j]
    return np.unique(mix(acc))
