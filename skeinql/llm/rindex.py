"""A run-length index of a set of short strings, built and streamed in numpy.

The Burrows-Wheeler transform of the strings (each followed by an end that sorts by the string's
number) is kept as runs of equal bytes: where each run starts, its byte, where its first row goes under
the LF mapping, and the text positions of its first and last rows. Rows that share a prefix of `length`
bytes with others are intervals, kept with their earliest text position. The suffix array itself isn't kept.

A string, indexed or not, is streamed backwards from its end for its matching statistics: at each byte
the longest match that starts there, counted up to `length`, a place of it in the text, and its row. Where
the row's run has the byte, an LF step finds the next row; else the nearest runs that have it on
either side are compared by their samples, and the longer match goes on. A match of `length` bytes
lies in an interval or occurs once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

END, OUTSIDE = -1, -2


class RunLengthIndex:
    def __init__(self, strings: list[bytes], length: int):
        """Text positions count the strings' bytes and ends in the order given."""
        self.length = length
        self.text, self.begin, size = self._joined(strings, END)
        n, k = len(self.text), len(strings)
        rank = self.text.astype(np.int64) + k
        rank[self.begin + size] = np.arange(k)
        sa, prefix, longest = self._sorted(rank, int(size.max(initial=0)) + 1, length)
        # Each end is a run, and no byte is one: no LF step passes from a string to another.
        letter = self.text[sa - 1]
        new = np.concatenate([[True], (letter[1:] != letter[:-1]) | (letter[1:] < 0), [True]]) if n else np.zeros(1, bool)
        edge = np.flatnonzero(new)
        self.rows, self.starts, self.letters = n, edge[:-1], letter[edge[:-1]].astype(np.int64)
        lengths = np.diff(edge)
        order = np.argsort(self.letters, kind="stable")
        self.to = np.empty(len(lengths), np.int64)
        self.to[order] = np.cumsum(lengths[order]) - lengths[order]
        #: The runs by letter, and their rows and text positions at either end.
        self.by_letter = self.letters[order] * len(order) + order
        self.ends = np.stack([self.starts, edge[1:] - 1])
        self.samples = sa[self.ends]
        alike = (prefix[sa[1:]] == prefix[sa[:-1]]) & (longest[sa[1:]] == longest[sa[:-1]])
        first = np.flatnonzero(np.concatenate([[True], ~alike])) if n else np.zeros(0, np.int64)
        earliest, stop = np.minimum.reduceat(sa, first) if n else first, np.append(first[1:], n)
        several = stop - first > 1
        self.intervals, self.stops, self.earliest = first[several], stop[several], earliest[several]

    @staticmethod
    def _joined(strings: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strings with an end after each, and where they begin and how long they are."""
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        stop = np.cumsum(size + 1) - 1
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int16)
        text[stop] = end
        return text, stop - size, size

    @staticmethod
    def _sorted(rank: np.ndarray, longest: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix array by prefix doubling, and two ranks that agree where `length` bytes do: of
        the prefix of the largest power of two within length, and of the one that ends at length. A
        rank is the first row of those that agree; rows that nothing agrees with aren't sorted again."""
        n, span = len(rank), 1
        prefix = tail = rank
        sa = np.argsort(rank)
        s = rank[sa]
        while True:
            first = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), np.arange(n), 0)) if n else s
            rank = np.empty(n, np.int64)
            rank[sa] = first
            if span <= length < 2 * span:
                prefix, tail = rank, rank[np.minimum(np.arange(n) + length - span, n - 1)]
            if span > longest and 2 * span > length:
                return sa, prefix, tail
            new = np.concatenate([[True], first[1:] != first[:-1], [True]]) if n else np.zeros(1, bool)
            tied = np.flatnonzero(~(new[:-1] & new[1:])) if n else np.zeros(0, np.int64)
            of = sa[tied]
            after = np.where(of + span < n, rank[np.minimum(of + span, n - 1)] + 1, 0)
            key = rank[of] * (n + 2) + after
            order = np.argsort(key)
            sa[tied] = of[order]
            s = first * (n + 2)
            s[tied] = key[order]
            span *= 2

    def _common(self, place: np.ndarray, other: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        """How many bytes of the text from each place agree with `other` from each `at`, up to `most`."""
        step = np.arange(most)
        same = self.text[np.minimum(place[:, None] + step, self.rows - 1)] == other[np.minimum(at[:, None] + step, len(other) - 1)]
        return np.where(same.all(1), most, same.argmin(1)) if most else np.zeros(len(place), np.int64)

    def stream(self, strings: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """From the last byte of each string to the first, all strings at once: (strings, their byte,
        and of the longest match from there its length up to the index's, place and row)."""
        other, begin, size = self._joined(strings, OUTSIDE)
        row, place, n = (np.zeros(len(strings), np.int64) for _ in range(3))
        start = self.samples[0, 0] if self.rows else 0  # of row 0, where a match of no bytes stands
        place += start
        todo = np.arange(len(strings))
        for t in range(1, int(size.max(initial=0)) + 1 if self.rows else 0):
            todo = todo[size[todo] >= t]
            at = begin[todo] + size[todo] - t
            byte = other[at].astype(np.int64)
            r, p, m = row[todo], place[todo], n[todo]
            run = np.searchsorted(self.starts, r, "right") - 1
            off = np.flatnonzero(self.letters[run] != byte)
            if len(off):
                most = min(t - 1, self.length)
                after = np.searchsorted(self.by_letter, byte[off] * len(self.starts) + run[off])
                best = np.full(len(off), -1)
                # Side 0: the next run's first row; side 1: the last row of the run before.
                for side, k in enumerate((after, after - 1)):
                    has = np.clip(k, 0, len(self.by_letter) - 1)
                    there, letter = self.by_letter[has] % len(self.starts), self.by_letter[has] // len(self.starts)
                    ok = np.flatnonzero((has == k) & (letter == byte[off]))
                    there = there[ok]
                    common = self._common(self.samples[side, there], other, at[off[ok]] + 1, most)
                    longer = common > best[ok]
                    ok, there, common = ok[longer], there[longer], common[longer]
                    best[ok], x = common, off[ok]
                    run[x], r[x], p[x], m[x] = there, self.ends[side, there], self.samples[side, there], common
                none = off[best < 0]
            else:
                none = off
            r, p, m = self.to[run] + r - self.starts[run], p - 1, np.minimum(m + 1, self.length)
            r[none], p[none], m[none] = 0, start, 0
            row[todo], place[todo], n[todo] = r, p, m
            yield todo, at - begin[todo], m, p, r

    def repeats(self, strings: list[bytes]) -> np.ndarray:
        """For the index's own strings: a row of flags for each, true where the match that starts at
        this byte of the string has the index's length and starts earlier in the text too."""
        out = np.zeros((len(strings), max(map(len, strings), default=0)), bool)
        if not len(self.intervals):
            return out
        for who, at, n, _, row in self.stream(strings):
            interval = np.searchsorted(self.intervals, row, "right") - 1
            known = (n == self.length) & (interval >= 0) & (row < self.stops[interval])
            out[who, at] = known & (self.earliest[interval] < self.begin[who] + at)
        return out
