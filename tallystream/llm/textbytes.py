"""Vectorised hashing of words and shingles over the bytes of many texts, for use inside Arrow tasks.

Words are found by byte class, which is safe in UTF-8 for ASCII separators. A word's hash is a polynomial
in random byte values modulo 2^64, mixed afterwards; long texts are worked through in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

BLOCK = 1 << 20
_BASE = 0xD1342543DE82EF95  # odd, 5 modulo 8
_SEED = 20240229
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@cache
def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=U64)
    if lower:
        values[65:91] = values[97:123]
    return values


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, dtype=U64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


@cache
def separators(chars: str) -> np.ndarray:
    """Which bytes separate words: the given ASCII characters, or all ASCII but letters for ''."""
    table = np.zeros(256, dtype=bool)
    if chars:
        table[[ord(c) for c in chars]] = True
    else:
        table[:128] = True
        table[65:91] = table[97:123] = False
    return table


def _blocks(data: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of about BLOCK bytes that end behind a separator."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            found = np.flatnonzero(sep[data[at:end]])
            while not len(found) and end < len(data):  # one word longer than a block
                end += BLOCK
                found = np.flatnonzero(sep[data[at:end]])
            end = at + found[-1] + 1 if len(found) else len(data)
        yield at, data[at:end]
        at = end


def words(data: np.ndarray, sep: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a byte array."""
    values, hashes, starts, ends = _byte_values(lower), [], [], []
    for at, block in _blocks(data, sep):
        inside = ~sep[block]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = BLOCK if len(block) <= BLOCK else 1 << int(len(block)).bit_length()
        up, down = _powers(size) if size == BLOCK else _powers.__wrapped__(size)
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(values[block] * up[: len(block)], dtype=U64)))
        h = (sums[last] - sums[first]) * down[first] + (last - first).astype(U64)
        hashes.append(mixed(h))
        starts.append(first + at)
        ends.append(last + at)
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def joined(texts: list[str | None], end: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by `end`, and the place at which each begins (and the length)."""
    raw = [((t or "") + end).encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint8), bounds


def slices(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `most` characters together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


@cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(_SEED + 1).integers(1, 1 << 63, n, dtype=U64) * U64(2) + U64(1)


def shingles(hashes: np.ndarray, word_bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each text, repeats included, and the bounds by text.

    A text with fewer words gives one shingle of all its words; one without words gives none.
    """
    by = _multipliers(width)
    n = np.diff(word_bounds)
    full = np.zeros(max(0, len(hashes) - width + 1), U64)
    for j in range(width):
        full += hashes[j: j + len(full)] * by[j]
    full = mixed(full)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(bounds[-1], U64)
    for i in range(len(n)):
        a, b = bounds[i], bounds[i + 1]
        w = word_bounds[i]
        if n[i] >= width:
            out[a:b] = full[w: w + b - a]
        elif n[i]:
            short = np.append(hashes[w: w + n[i]] * by[: n[i]], n[i].astype(U64)).sum(dtype=U64, keepdims=True)
            out[a] = mixed(mixed(short) + U64(1))[0]
    return out, bounds


def shingle_sets(texts: list[str | None], width: int, blanks: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of every text (A-Z lower-cased) and their bounds."""
    data, bounds = joined(texts)
    hashes, starts, _ = words(data, separators(blanks))
    return shingles(hashes, np.searchsorted(starts, bounds), width)
