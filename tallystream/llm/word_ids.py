"""Ids of many texts from the ids of their distinct words, inside Arrow tasks.

A text is cut before every single blank between two characters that are no white space; the caller's `solve` must give the same ids
for a text and for its parts one after another. Arrow cuts and counts the words of a batch, so Python sees each distinct word once, and
a worker keeps the words it has met in Arrow arrays and their ids in numpy, in two generations of bounded size, so that known
words are found and gathered in bulk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 150_000  # words after which a worker begins a new generation; it keeps two
LONGEST_KEPT = 200  # longer words are solved each time, so that the memory of a generation has a bound

# characters without width that some rules take for white space
HIDDEN = "\u180e\u200b-\u200f\u2060\ufeff"
_SPACES = "\t\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + HIDDEN
# texts that Arrow must not cut at every blank, or that hold one of the marks used here
_UNEVEN = f"^$|^ | $|  | \n|\n |[\\x00\u2581{_SPACES}]"
_CUT = re.compile(f"(?<=[^ \n{_SPACES}])(?= [^ \n{_SPACES}])")


def cut_words(text: str) -> list[str]:
    """Parts of any text, each but the first with its blank."""
    return _CUT.split(text) if text else []


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about `most`."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= most or i + 1 == len(sizes):
            yield first, i + 1
            first, total = i + 1, 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs start .. start + length - 1, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or starts.max() < 1 << 31) else np.int64
    return np.repeat((starts - ends + lengths).astype(kind), lengths) + np.arange(total, dtype=kind)


class _Generation:
    """Words as an Arrow array and their ids, one flat run each, so that a batch's words are looked up and gathered in bulk."""

    def __init__(self, words: pa.Array | None = None, flat: np.ndarray | None = None, length: np.ndarray | None = None):
        self.words = pa.array([], pa.string()) if words is None else words
        self.flat = np.zeros(0, "<i4") if flat is None else flat
        self.length = np.zeros(0, np.int64) if length is None else length
        self.start = np.cumsum(self.length) - self.length

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, -1 for those not here."""
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at those places, one after another, and how many each has."""
        return self.flat[ragged(self.start[at], self.length[at])], self.length[at]

    def plus(self, words: pa.Array, flat: np.ndarray, length: np.ndarray) -> _Generation:
        return _Generation(
            pa.concat_arrays([self.words, words]), np.concatenate([self.flat, flat]), np.concatenate([self.length, length]))


class WordIds:
    """Encodes texts through their words. `solve` gives the ids of words as little-endian int32 bytes; `cut` cuts texts that are not
    plain; `first` and `later` are put before the first word and before each other one."""

    def __init__(self, solve: Callable[[list[str]], list[bytes]], cut: Callable[[str], list[str]], first: str, later: str,
                 remembered: int = REMEMBERED):
        self.solve, self.cut, self.first, self.later, self.remembered = solve, cut, first, later, remembered
        self.known = _Generation()
        self.older = _Generation()

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one run after another, and how many each has. Arrow finds the known ones; Python sees the new."""
        at = self.known.find(words)
        miss = np.flatnonzero(at < 0)
        rest = words.take(pa.array(miss))
        old = self.older.find(rest)
        back = old >= 0
        back_flat, back_length = self.older.runs(old[back])
        new = rest.filter(pa.array(~back))
        solved = self.solve(new.to_numpy(zero_copy_only=False).tolist()) if len(new) else []
        new_length = np.array([len(b) for b in solved], np.int64) // 4
        new_flat = np.frombuffer(b"".join(solved), "<i4")
        pool = np.concatenate([self.known.flat, back_flat, new_flat])
        start, length = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        hit = at >= 0
        start[hit], length[hit] = self.known.start[at[hit]], self.known.length[at[hit]]
        for rows, base, lengths in ((miss[back], len(self.known.flat), back_length),
                                    (miss[~back], len(self.known.flat) + len(back_flat), new_length)):
            start[rows], length[rows] = base + np.cumsum(lengths) - lengths, lengths
        out = pool[ragged(start, length)]
        kept = pc.utf8_length(new).to_numpy(zero_copy_only=False) <= LONGEST_KEPT
        self.known = self.known.plus(
            pa.concat_arrays([rest.filter(pa.array(back)), new.filter(pa.array(kept))]),
            np.concatenate([back_flat, new_flat[np.repeat(kept, new_length)]]), np.concatenate([back_length, new_length[kept]]))
        if len(self.known.words) > self.remembered:
            self.older, self.known = self.known, _Generation()
        return out, length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; a null has none."""
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.binary_join_element_wise("\0", texts.filter(pa.array(~uneven)), ""), " ")
        coded = lists.flatten().dictionary_encode()
        # the first word of a text is marked by the NUL put before it; Arrow puts `first` or `later` in front
        dictionary = coded.dictionary.cast(pa.string())
        opening = pc.starts_with(dictionary, "\0")
        words = pc.if_else(
            opening, pc.utf8_replace_slice(dictionary, 0, 1, self.first), pc.utf8_replace_slice(dictionary, 0, 0, self.later))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.zeros(len(texts), np.int64)
        n[~uneven] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        more: list[str] = []
        if uneven.any():  # their words are numbered in Python and put in where they belong; they may hold what Arrow cannot
            cut = [self.cut(t) for t in texts.filter(pa.array(uneven)).to_pylist()]
            at = {w: i for i, w in enumerate(words.to_numpy(zero_copy_only=False).tolist())}
            more = [w for w in dict.fromkeys(w for x in cut for w in x) if w not in at]
            at.update(zip(more, range(len(words), len(words) + len(more))))
            own = [[at[w] for w in x] for x in cut]
            n[uneven] = [len(x) for x in own]
            from_ = np.repeat(uneven, n)
            both = np.empty(len(from_), np.int64)
            both[~from_] = codes
            both[from_] = [c for x in own for c in x]
            codes = both
        flat, length = self._ids(words)
        if more:  # solved each time they come
            solved = self.solve(more)
            flat = np.concatenate([flat, np.frombuffer(b"".join(solved), "<i4")])
            length = np.concatenate([length, np.array([len(b) for b in solved], np.int64) // 4])
        start = np.cumsum(length) - length
        per_word = length[codes]
        out = flat[ragged(start[codes], per_word)]
        sums = np.concatenate(([0], np.cumsum(per_word)))
        last = np.cumsum(n)
        return out, sums[last] - sums[last - n]
