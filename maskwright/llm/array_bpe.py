"""Byte-pair merging over ragged numpy arrays.

All words of a batch lie one after another in one flat array of symbols. In each round every word's lowest pair
rank is found by a segmented minimum, all its leftmost, non-overlapping occurrences are merged at once, and the
array is compacted; words without a pair left leave the array. The rounds end when it is empty.

Merging all occurrences at once equals merging them one by one as long as a merge cannot give birth to a pair of
a better rank. Pairs for which it can are known beforehand (``alone``); of those only the leftmost is merged.

Where two neighbours never stand together inside a merged symbol no merge crosses, so words are first cut there into
regions that go their own ways. A region of more than ``LONG`` symbols, such as a long run of blanks, would need a round for
each merge that goes alone; it is merged by a heap of pairs instead, in time that grows almost with its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np

SHIFT = 22  # symbols are below 2**22
NONE = np.iinfo(np.int64).max
LONG, PLACE = 512, 40  # a place in a region is below 2**40


class Merges:
    """pairs: (left, right) -> (rank, merged symbol)."""

    def __init__(self, left, right, rank, merged):
        left, right, rank, merged = (np.asarray(x, np.int64) for x in (left, right, rank, merged))
        key = (left << SHIFT) | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = key[order], rank[order], merged[order]
        best: dict[int, int] = {}  # symbol -> best rank of a pair that it takes part in
        for part in (left, right):
            for s, r in zip(part.tolist(), rank.tolist(), strict=True):
                if r < best.get(s, NONE):
                    best[s] = r
        self.alone = np.array([best.get(m, NONE) <= r for m, r in zip(self.merged.tolist(), self.rank.tolist(), strict=True)], bool)

        self.table = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        self.together = self.neighbours(left.tolist(), right.tolist(), merged.tolist())

    @staticmethod
    def neighbours(left: list[int], right: list[int], merged: list[int]) -> np.ndarray:
        """Keys, in order, of the pairs of unmerged symbols that stand together inside some merged one."""
        parts = {m: (a, b) for a, b, m in zip(left, right, merged, strict=True)}
        ends: dict[int, tuple[int, int]] = {}

        def outer(symbol: int) -> tuple[int, int]:
            """The first and the last unmerged symbol of a symbol."""
            todo = [symbol]
            while todo:
                s = todo[-1]
                if s in ends or s not in parts:
                    ends.setdefault(s, (s, s))
                    todo.pop()
                    continue
                a, b = parts[s]
                wanted = [x for x in (a, b) if x not in ends]
                if wanted:
                    todo += wanted
                else:
                    ends[s] = (ends[a][0], ends[b][1])
            return ends[symbol]

        return np.unique(np.array([(outer(a)[1] << SHIFT) | outer(b)[0] for a, b in zip(left, right, strict=True)], np.int64))

    def regions(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where the regions of all words start."""
        starts = np.zeros(len(symbols), bool)
        starts[np.cumsum(lengths) - lengths] = True
        if len(symbols) > 1:
            if not len(self.together):
                starts[:] = True
                return np.flatnonzero(starts)
            key = (symbols[:-1] << SHIFT) | symbols[1:]
            at = np.minimum(np.searchsorted(self.together, key), len(self.together) - 1)
            starts[1:] |= self.together[at] != key
        return np.flatnonzero(starts)

    def by_heap(self, region: list[int]) -> list[int]:
        """One region, the best pair first and of equal ones the leftmost."""
        n, table = len(region), self.table
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        place = (1 << PLACE) - 1
        heap = [found[0] << PLACE | i for i, (a, b) in enumerate(zip(region, region[1:], strict=False)) if (found := table.get(a << SHIFT | b))]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & place
            j = after[i]
            if region[i] < 0 or j == n:
                continue
            found = table.get(region[i] << SHIFT | region[j])
            if not found or found[0] != top >> PLACE:
                continue  # the pair that was here is gone
            region[i], region[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = table.get(region[i] << SHIFT | region[k])
                if found:
                    heapq.heappush(heap, found[0] << PLACE | i)
            h = before[i]
            if h >= 0:
                found = table.get(region[h] << SHIFT | region[i])
                if found:
                    heapq.heappush(heap, found[0] << PLACE | h)
        return [s for s in region if s >= 0]

    def find(self, symbols: np.ndarray) -> np.ndarray:
        """For each position the index of the pair that starts there, or -1."""
        out = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1 and len(self.key):
            key = (symbols[:-1] << SHIFT) | symbols[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[:-1] = np.where(self.key[at] == key, at, -1)
        return out

    def apply(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols of words of the given lengths (none empty) -> merged symbols and lengths, words in the same order."""
        count, word_of = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
        begins = self.regions(symbols, lengths)
        word_of, sizes = word_of[begins], np.diff(np.append(begins, len(symbols)))
        word = np.repeat(np.arange(len(begins)), sizes)
        done_symbols, done_words = [], []
        if (sizes > LONG).any():
            for r in np.flatnonzero(sizes > LONG).tolist():
                made = self.by_heap(symbols[begins[r] : begins[r] + sizes[r]].tolist())
                done_symbols.append(np.array(made, np.int64))
                done_words.append(np.full(len(made), r))
            rest = np.repeat(sizes <= LONG, sizes)
            symbols, word = symbols[rest], word[rest]
        while len(symbols):
            first = np.empty(len(word), bool)
            first[0] = True
            np.not_equal(word[1:], word[:-1], out=first[1:])
            starts = np.flatnonzero(first)
            pair = self.find(symbols)
            pair[starts[1:] - 1] = -1  # no pair across words
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            live = np.repeat(least < NONE, sizes)
            chosen = live & (rank == np.repeat(least, sizes))
            done_symbols.append(symbols[~live])
            done_words.append(word[~live])
            at = np.flatnonzero(chosen)
            if not len(at):
                break
            # in a run of neighbours every second one, from the left; where merges go alone, a word's first
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            take = place % 2 == 0
            alone = self.alone[pair[at]]
            if alone.any():
                leading = np.diff(word[at], prepend=-1) != 0
                take &= ~alone | leading
            at = at[take]
            symbols[at] = self.merged[pair[at]]
            live[at + 1] = False
            symbols, word = symbols[live], word[live]
        if not done_words:
            return symbols, np.zeros(count, np.int64)
        all_words = np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(word_of[all_words], minlength=count)


class Bounded(dict):
    """A cache for one worker: two generations of at most `most` entries each, so that memory stays bounded.

    A full generation becomes the old one; what is met again moves to the young one, so frequent entries stay.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def make_room(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def missing(self, keys: Iterable) -> set:
        """Of keys those that neither generation holds; all others are in the young one afterwards."""
        fresh = {k for k in set(keys) if k not in self}  # difference() would go through the whole cache
        if self.old:
            met = [k for k in fresh if k in self.old]
            self.update(zip(met, map(self.old.__getitem__, met), strict=True))
            fresh.difference_update(met)
        return fresh
