"""Byte-pair merging over ragged numpy arrays, many words at once.

The symbols of all words lie in one flat array. In each round every word finds its own lowest-rank
pair (the pair keys are sorted once, so a lookup is a binary search) and merges it; words without
a known pair leave the arrays. A round merges all copies of a word's best pair, unless a pair made
from the merged symbol could rank before it: then only the leftmost copy, as the sequential rule
would. A word of more than LONG symbols could need as many rounds as it has symbols, each over all
of it: it is merged alone, with its pairs in a heap, in about linear time.
"""

from __future__ import annotations

import heapq

import numpy as np

NO_RANK = np.iinfo(np.int64).max
LONG = 1024


class PairTable:
    """Merges: (left, right) -> (rank, merged), all symbol numbers below `size`."""

    def __init__(self, left, right, rank, merged, size: int):
        left, right, rank, merged = (np.asarray(x, np.int64) for x in (left, right, rank, merged))
        key = left * size + right
        order = np.lexsort((rank, key))
        key, first = np.unique(key[order], return_index=True)
        self.size, self.key = size, key
        self.rank, self.merged = rank[order][first], merged[order][first]
        # the lowest rank of any pair that a symbol takes part in
        lowest = np.full(size, NO_RANK)
        np.minimum.at(lowest, self.key // size, self.rank)
        np.minimum.at(lowest, self.key % size, self.rank)
        self.all_copies = lowest[self.merged] > self.rank
        self._links: dict[int, tuple[int, int]] | None = None

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NO_RANK if it has none) and its place in the table."""
        if not len(self.key):
            return np.full(len(left), NO_RANK), np.zeros(len(left), np.int64)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        # symbols outside the vocabulary are numbered from `size` on and pair with nothing
        known = (self.key[at] == key) & (left < self.size) & (right < self.size)
        return np.where(known, self.rank[at], NO_RANK), at


    def links(self) -> dict[int, tuple[int, int]]:
        """(rank, merged) by left * size + right."""
        if self._links is None:
            self._links = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        return self._links


def merge_long(word: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The symbols of one long word that survive: lowest rank first, then leftmost, by a heap of (rank, place)."""
    links, size, n = pairs.links(), pairs.size, len(word)
    rank, _ = pairs.find(word[:-1], word[1:])
    start = np.flatnonzero(rank < NO_RANK)
    heap = list(zip(rank[start].tolist(), start.tolist(), strict=True))
    heapq.heapify(heap)
    sym, after, before = word.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

    def link(a: int, b: int) -> tuple[int, int] | None:
        return links.get(a * size + b) if a < size and b < size else None

    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        # a pair whose symbols have changed since it was pushed is stale
        if sym[i] < 0 or j >= n or (found := link(sym[i], sym[j])) is None or found[0] != r:
            continue
        sym[i], sym[j] = found[1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (right := link(sym[i], sym[k])) is not None:
                heapq.heappush(heap, (right[0], i))
        h = before[i]
        if h >= 0 and (left := link(sym[h], sym[i])) is not None:
            heapq.heappush(heap, (left[0], h))
    out = np.array(sym, np.int64)
    return out[out >= 0]


def merge(flat: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that survive, word after word, and the number of them in each word.

    `flat` holds the words' symbols one after another. Empty input gives empty arrays; a word of no
    symbols keeps none.
    """
    done_sym, done_word = [], []
    sym, lengths = np.asarray(flat, np.int64), np.asarray(lengths, np.int64)
    word = np.repeat(np.arange(len(lengths)), lengths)
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        end = np.cumsum(lengths)
        for w in long.tolist():
            done_sym.append(merge_long(sym[end[w] - lengths[w] : end[w]], pairs))
            done_word.append(np.full(len(done_sym[-1]), w))
        short = lengths[word] <= LONG
        sym, word = sym[short], word[short]
    while len(sym):
        same = word[:-1] == word[1:]
        rank, at = pairs.find(sym[:-1], sym[1:])
        rank = np.append(np.where(same, rank, NO_RANK), NO_RANK)
        at = np.append(at, 0)
        starts = np.flatnonzero(np.append(True, ~same))
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
        live = best < NO_RANK
        if not live.all():
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            sym, word, rank, at, best = sym[live], word[live], rank[live], at[live], best[live]
            if not len(sym):
                break
        spot = np.flatnonzero(rank == best)
        # copies that overlap (a a a): every second one, from the left
        fresh = np.append(True, np.diff(spot) > 1)
        spot = spot[(spot - spot[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
        whole = pairs.all_copies[at[spot]]
        if not whole.all():
            spot = spot[whole | np.append(True, word[spot][1:] != word[spot][:-1])]
        sym[spot] = pairs.merged[at[spot]]
        kept = np.ones(len(sym), bool)
        kept[spot + 1] = False
        sym, word = sym[kept], word[kept]
    if not done_sym:
        return np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(lengths))
