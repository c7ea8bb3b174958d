"""Benchmark decontamination by greedy string tiling.

The benchmark is taken in blocks of bounded size, each a stated query set against all documents.
Within a block, documents and items are joined on seeds (runs of `MIN_MATCH` words). For each pair
that the seeds give, the longest common runs of words that are not yet marked are found by running
Karp-Rabin hashes, longest first, and marked as tiles. Tiles may come in any order, so a passage
whose sentences were moved is still covered. A pair is a leak if the tiles cover `COVERAGE` of the
item's words.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MIN_MATCH = 5
COVERAGE = 0.5
#: UTF-8 bytes of benchmark text that go to the tasks at once.
BLOCK_BYTES = 8_000_000
WORD = re.compile(r"\w+")
BASE, PRIME = 1_000_003, (1 << 61) - 1
SCHEMA = "doc_id long, item_id long, n_item_words long, n_tiles long, covered long, coverage double"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _matches(item: list[int], doc: list[int], free_i: list[bool], free_d: list[bool], s: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of `s` unmarked words or more, by running hashes of `s` words."""

    def running(seq, free):
        top, h, run = pow(BASE, s, PRIME), 0, 0
        for k, (x, ok) in enumerate(zip(seq, free, strict=True)):
            if not ok:
                h = run = 0
                continue
            h = (h * BASE + x + 1) % PRIME
            run += 1
            if run > s:
                h = (h - (seq[k - s] + 1) * top) % PRIME
            if run >= s:
                yield k - s + 1, h

    table: dict[int, list[int]] = {}
    for i, h in running(item, free_i):
        table.setdefault(h, []).append(i)
    found = []
    for j, h in running(doc, free_d):
        for i in table.get(h, ()):
            # a run that starts earlier on both sides has been found there
            if i and j and free_i[i - 1] and free_d[j - 1] and item[i - 1] == doc[j - 1]:
                continue
            k = 0
            while i + k < len(item) and j + k < len(doc) and free_i[i + k] and free_d[j + k] and item[i + k] == doc[j + k]:
                k += 1
            if k >= s:
                found.append((k, i, j))
    return found


def tiles(item: list[int], doc: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in item, place in doc): longest first, then leftmost, without overlap.

    Words are numbers; a negative number in `doc` matches nothing.
    """
    free_i, free_d = [True] * len(item), [x >= 0 for x in doc]
    out: list[tuple[int, int, int]] = []
    s = max(min_match, len(item) // 2)
    while True:
        found = _matches(item, doc, free_i, free_d, s)
        longest = max(found, default=(0,))[0]
        if longest > 2 * s:
            s = longest
            continue
        blocked = False
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if not (all(free_i[i : i + k]) and all(free_d[j : j + k])):
                blocked = True  # what is left of it has to stand in line again
                break
            free_i[i : i + k] = free_d[j : j + k] = [False] * k
            out.append((k, i, j))
        if blocked:
            continue
        if s <= min_match:
            return out
        s = max(min_match, s // 2)


class Items:
    """A block of benchmark items, ready to meet documents."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.min_match = min_match
        self.number: dict[str, int] = {}
        self.items = []
        #: By their number of words, the items that have too few for a seed, under their words.
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words_of(text or "")]
            if len(ids) >= min_match:
                self.items.append((item_id, ids))
            elif ids:
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids), []).append(item_id)
        self.power = np.array([pow(BASE, k, 1 << 64) | 1 for k in range(1, min_match + 1)], np.uint64)
        seeds: dict[int, list[tuple[int, int]]] = {}
        for n, (_, ids) in enumerate(self.items):
            for p, h in enumerate(self._seed(np.array(ids), min_match).tolist()):
                seeds.setdefault(h, []).append((n, p))
        self.seeds = seeds
        self.sorted = np.array(sorted(seeds), np.uint64)

    def _seed(self, ids: np.ndarray, size: int) -> np.ndarray:
        m = len(ids) - size + 1
        out = np.zeros(max(0, m), np.uint64)
        for k in range(size):
            out += (ids[k : k + m].astype(np.uint64) + np.uint64(7)) * self.power[k] if m > 0 else out
        x = out ^ (out >> np.uint64(29))
        return x * np.uint64(0xBF58476D1CE4E5B9)

    def _whole(self, ids: np.ndarray, at: np.ndarray):
        """What `leaks` gives of the short items: a row that holds all words of one, in a run, is a pair."""
        for n, known in self.short.items():
            names = self._seed(np.array([w for words in known for w in words]), n)[::n]
            hit = np.flatnonzero(np.isin(self._seed(ids, n), names))
            row = np.searchsorted(at, hit, "right") - 1
            inside = hit + n <= at[row + 1]
            seen = set()
            for j, r in zip(hit[inside].tolist(), row[inside].tolist(), strict=True):
                words = tuple(ids[j : j + n].tolist())
                if words in known and (r, words) not in seen:
                    seen.add((r, words))
                    for item_id in known[words]:
                        yield r, item_id, n, 1, n

    def leaks(self, texts: list[str], coverage: float):
        """(row, item_id, words of the item, tiles, covered) of every pair that reaches `coverage`."""
        if not self.items and not self.short:
            return
        k, get = self.min_match, self.number.get
        split = [[get(w, -1) for w in words_of(t)] for t in texts]
        sizes = [len(x) for x in split]
        ids = np.fromiter((x for d in split for x in d), np.int64, sum(sizes))
        at = np.cumsum([0, *sizes])
        yield from self._whole(ids, at)
        m = len(ids) - k + 1
        if m <= 0 or not self.items:
            return
        seed = self._seed(ids, k)
        spot = np.minimum(np.searchsorted(self.sorted, seed), len(self.sorted) - 1)
        hit = np.flatnonzero(self.sorted[spot] == seed)
        row = np.searchsorted(at, hit, "right") - 1
        inside = hit + k <= at[row + 1]
        hit, row = hit[inside], row[inside]
        for r in np.unique(row).tolist():
            here = hit[row == r] - at[r]
            doc = split[r]
            near: dict[int, set[int]] = {}
            for j in here.tolist():
                for n, p in self.seeds[int(seed[at[r] + j])]:
                    near.setdefault(n, set()).add(p)
            # what seeds leave out is in no tile: drop it, with a gap, before tiling
            keep = np.zeros(len(doc) + k, bool)
            for d in range(k):
                keep[here + d] = True
            part = [x if ok else -1 for x, ok in zip(doc, keep, strict=False)]
            short = [x for n, x in enumerate(part) if x >= 0 or n == 0 or part[n - 1] >= 0]
            for n, places in near.items():
                item_id, item = self.items[n]
                if len({p + d for p in places for d in range(k)}) < coverage * len(item):
                    continue
                found = tiles(item, short, k)
                covered = sum(t[0] for t in found)
                if covered >= coverage * len(item):
                    yield r, item_id, len(item), len(found), covered


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The benchmark's items in lists of bounded size; the number of lists follows its size."""
    slim = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        part = slim if n == 1 else slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The pairs of document and item whose tiles cover `coverage` of the item.

    Null and empty texts are in no pair. An item of fewer than `min_match` words is one tile or none: all
    of its words have to stand in the document in a run. Repeated rows and repeated items each give their pairs; a null id stays null. Tiles are taken longest first,
    then leftmost in the item, then in the document. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    parts = []
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):

        def rows(batches, block=block):
            items = Items(block, min_match)
            for b in batches:
                ids = b.column(0).to_pylist()
                found = [(ids[r], i, n, t, c, c / n) for r, i, n, t, c in items.leaks([t or "" for t in b.column(1).to_pylist()], coverage)]
                cols = list(zip(*found, strict=True)) or [()] * 6
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split(" ")[0] for x in SCHEMA.split(", ")])

        parts.append(slim.mapInArrow(rows, SCHEMA))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that leak no item, with all their columns, without a shuffle. Null texts stay."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    for block in _blocks(benchmark, "item_id", "text", block_bytes):

        def rows(batches, block=block):
            items = Items(block, min_match)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for leak in items.leaks([t or "" for t in b.column(place).to_pylist()], coverage):
                    keep[leak[0]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs
