"""Elias-Fano coded rising sequences and an n-gram trie of them, laid out flat so that a file can be mapped and queried.

A rising sequence of n numbers below U takes about 2 + log2(U / n) bits a number: the low bits side by side, the high bits as
gaps in unary. All look-ups take arrays of queries.

The trie holds runs of three words, last word first: words, the words before them, the words before those. A child is stored
as its parent's place times the width of the level plus its identifier *within the context*: for the middle level the rank
among words that precede any word, for the last level the rank among the words that ever stand two before the same last
word. So identifiers are small, every level rises, and a search for a child is one successor search.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Sequence

import numpy as np

_U = np.uint64


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit with this rank in each 64-bit word."""
    place = np.zeros(len(words), dtype=np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = words & _U((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = rank >= count
        rank = rank - count * up
        words = np.where(up, words >> _U(width), low)
        place += width * up
    return place


def _bits(ones: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, the first bit lowest."""
    packed = np.packbits(ones, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, dtype=np.uint8)]).view(_U)


class EliasFano:
    """A rising sequence of numbers that are not negative; equal neighbours are allowed."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.head, self.low, self.high, self.ones = head, low, high, ones
        self.n, self.width = int(head[0]), int(head[1])
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        width = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
        low = np.empty((n, width), dtype=np.uint8)
        for bit in range(width):
            low[:, bit] = (values >> bit) & 1
        low = _bits(low.reshape(-1))
        ones = np.zeros(n + (int(values[-1]) >> width) + 2 if n else 1, dtype=np.uint8)
        if n:
            ones[(values >> width) + np.arange(n)] = 1
        high = _bits(ones)
        counts = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return cls(np.array([n, width], dtype=np.int64), np.concatenate([low, np.zeros(2, dtype=_U)]), high, counts)

    def parts(self) -> list[np.ndarray]:
        return [self.head, self.low, self.high, self.ones]

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), dtype=np.int64)
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(_U)
        # A shift by 64 is not defined, so the second word moves in two steps.
        value = (self.low[word] >> shift) | ((self.low[word + 1] << (_U(63) - shift)) << _U(1))
        return (value & _U((1 << self.width) - 1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, at, "right") - 1
        return ((word * 64 + _select(self.high[word], at - self.ones[word]) - at) << self.width) | self._low(at)

    def _starts(self, bucket: np.ndarray) -> np.ndarray:
        """How many numbers have smaller high bits."""
        zero = bucket - 1
        word = np.clip(np.searchsorted(self.zeros, zero, "right") - 1, 0, len(self.high) - 1)
        place = word * 64 + _select(~self.high[word], zero - self.zeros[word]) - zero
        return np.where(bucket == 0, 0, np.minimum(place, self.n))

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place of each value, -1 where it is missing: the first place not before it, and whether it stands there."""
        found = np.full(len(values), -1, dtype=np.int64)
        if not self.n:
            return found
        last = int(self.get(np.array([self.n - 1]))[0])
        inside = np.flatnonzero((values >= 0) & (values <= last))
        x = values[inside]
        bucket, rest = x >> self.width, x & ((1 << self.width) - 1)
        start, end = self._starts(bucket), self._starts(bucket + 1)
        stop = end.copy()
        while (open_ := start < end).any():
            middle = (start + end) >> 1
            right = open_ & (self._low(np.minimum(middle, self.n - 1)) < rest)
            start, end = np.where(right, middle + 1, start), np.where(open_ & ~right, middle, end)
        hit = (start < stop) & (self._low(np.minimum(start, self.n - 1)) == rest)
        found[inside[hit]] = start[hit]
        return found


class TrigramTrie:
    """Runs of three words with a value for each run and each of its endings, and a second one for pairs.

    ``find`` answers for (last, middle, first): the place of the longest known ending in each level, -1 below.
    """

    LEVELS = ("words", "before", "pairs", "pair_starts", "earlier", "skips", "skip_starts", "runs", "run_starts")
    VALUES = ("word_code", "pair_code", "pair_norm", "run_code")

    def __init__(self, levels: dict[str, EliasFano], values: dict[str, np.ndarray]):
        self.levels, self.values = levels, values
        wide = levels["skip_starts"]
        starts = wide.get(np.arange(wide.n))
        self.run_width = int(np.diff(starts).max(initial=0)) or 1

    @classmethod
    def of(cls, words: np.ndarray, pairs: Sequence[np.ndarray], runs: Sequence[np.ndarray], values: dict[str, np.ndarray]) -> TrigramTrie:
        """``words`` sorted ids; ``pairs`` (place of the word, id before), sorted; ``runs`` (place of the pair, id before that), sorted."""
        word_of, middle = pairs
        pair_of, first = runs
        before, earlier = np.unique(middle), np.unique(first)
        last = word_of[pair_of]
        skips = np.unique(last * max(len(earlier), 1) + np.searchsorted(earlier, first))
        skip_starts = np.searchsorted(skips, np.arange(len(words) + 1) * max(len(earlier), 1))
        relative = np.searchsorted(skips, last * max(len(earlier), 1) + np.searchsorted(earlier, first)) - skip_starts[last]
        width = int(np.diff(skip_starts).max(initial=0)) or 1
        # The order of runs below a pair is that of their ids, and so that of their identifiers.
        levels = {
            "words": words,
            "before": before,
            "pairs": word_of * max(len(before), 1) + np.searchsorted(before, middle),
            "pair_starts": np.searchsorted(word_of, np.arange(len(words) + 1)),
            "earlier": earlier,
            "skips": skips,
            "skip_starts": skip_starts,
            "runs": pair_of * width + relative,
            "run_starts": np.searchsorted(pair_of, np.arange(len(word_of) + 1)),
        }
        return cls({name: EliasFano.of(levels[name].astype(np.int64)) for name in cls.LEVELS}, values)

    def to_bytes(self) -> bytes:
        """A directory of offsets, then every array on a border of eight bytes."""
        arrays = [a for name in self.LEVELS for a in self.levels[name].parts()] + [self.values[name] for name in self.VALUES]
        kinds, offset, directory, parts = {"i8": 0, "u8": 1, "i2": 2}, 8 + 24 * len(arrays), [], []
        for a in arrays:
            data = a.tobytes()
            directory.append(struct.pack("<qqq", kinds[a.dtype.str[1:]], offset, len(a)))
            parts.append(data + bytes(-len(data) % 8))
            offset += len(parts[-1])
        return struct.pack("<q", len(arrays)) + b"".join(directory) + b"".join(parts)

    @classmethod
    def over(cls, buffer) -> TrigramTrie:
        """The trie in a buffer, without copying it."""
        kinds = [np.dtype("<i8"), np.dtype("<u8"), np.dtype("<i2")]
        (count,) = struct.unpack_from("<q", buffer)
        entries = [struct.unpack_from("<qqq", buffer, 8 + 24 * i) for i in range(count)]
        arrays = [np.frombuffer(buffer, kinds[kind], n, offset) for kind, offset, n in entries]
        levels = {name: EliasFano(*arrays[4 * i : 4 * i + 4]) for i, name in enumerate(cls.LEVELS)}
        return cls(levels, dict(zip(cls.VALUES, arrays[4 * len(cls.LEVELS) :], strict=True)))

    @classmethod
    def mapped(cls, data: bytes) -> TrigramTrie:
        """The trie in a memory map of its own that no file backs."""
        space = mmap.mmap(-1, max(len(data), 1))
        space.write(data)
        return cls.over(space)

    @classmethod
    def open(cls, path: str) -> TrigramTrie:
        """The trie in a local file, mapped."""
        with open(path, "rb") as file:
            return cls.over(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def find_pairs(self, words: np.ndarray, last: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last words and of the pairs; ``last`` and ``middle`` are places in the ids ``words``."""
        word, near = self.levels["words"].find(words)[last], self.levels["before"].find(words)[middle]
        return word, self.levels["pairs"].find(np.where((word >= 0) & (near >= 0), word * max(self.levels["before"].n, 1) + near, -1))

    def find_runs(self, words: np.ndarray, word: np.ndarray, pair: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of the runs below these words and pairs; ``first`` are places in the ids ``words``."""
        far = self.levels["earlier"].find(words)[first]
        skip = self.levels["skips"].find(np.where((pair >= 0) & (far >= 0), word * max(self.levels["earlier"].n, 1) + far, -1))
        starts = self.levels["skip_starts"].get(np.arange(self.levels["skip_starts"].n))
        # The identifier of the first word within its context: its place among all that stand two before the last one.
        return self.levels["runs"].find(np.where(skip >= 0, pair * self.run_width + skip - starts[np.maximum(word, 0)], -1))

    def find(self, last: np.ndarray, middle: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, place = np.unique(np.concatenate([last, middle, first]), return_inverse=True)
        last, middle, first = np.split(place, 3)
        word, pair = self.find_pairs(words, last, middle)
        return word, pair, self.find_runs(words, word, pair, first)
