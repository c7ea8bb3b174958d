"""Token counts under a sentencepiece BPE model, by rank-synchronous array merging.

Pre-tokens are the runs between places where no vocabulary piece can reach across: a piece never
has a space mark after other characters, nor a character that the vocabulary lacks. Merging each
alone is therefore the same as merging the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import PairTable, merge
from .common import bounded_batches

MARK = "▁"
#: Words whose counts a worker remembers, and the longest word that it remembers.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
MERGE_SYMBOLS = 2_000_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """Counts tokens as the model file's own library does, without begin or end tokens."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = {
            model.id_to_piece(i): i
            for i in range(n)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        }
        self.size = n
        char = {p: i for p, i in pieces.items() if len(p) == 1}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans words: this model needs whole texts")
        order = {i: r for r, i in enumerate(sorted(pieces.values(), key=lambda i: -model.get_score(i)))}
        left, right, rank, merged = [], [], [], []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                if (a := pieces.get(p[:k])) is not None and (b := pieces.get(p[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(order[i])
                    merged.append(i)
        self.pairs = PairTable(left, right, rank, merged, n)
        stops = "".join(c for c in "\n\t\r" if c not in char)
        mark = re.escape(MARK)
        self.split = re.compile(f"{mark}*[^{mark}{stops}]+|{mark}+" + (f"|[{stops}]" if stops else "")).findall
        # a character that the vocabulary lacks costs its UTF-8 bytes: symbol size + bytes
        point = np.arange(0x110000)
        self.symbol = n + 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        self.symbol[[ord(c) for c in char]] = list(char.values())
        self.cache: dict[str, int] = {}

    def _merge(self, words: list[str]) -> Iterator[tuple[str, int]]:
        while words:
            part, total = [], 0
            while words and total < MERGE_SYMBOLS:
                part.append(words.pop())
                total += len(part[-1])
            flat = self.symbol[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)]
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            sym, left = merge(flat, lengths, self.pairs)
            cost = np.bincount(np.repeat(np.arange(len(part)), left), np.where(sym < self.size, 1, sym - self.size), len(part))
            yield from zip(part, cost.astype(np.int64).tolist(), strict=True)

    def count(self, texts: list[str]) -> list[int]:
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        cache = self.cache
        new = {w for ws in split for w in ws if w not in cache}
        if len(cache) + len(new) > CACHE_WORDS:
            # the words of this batch stay: they hold the frequent ones
            used = {w: cache[w] for ws in split for w in ws if w in cache}
            cache.clear()
            cache.update(used)
        fresh = dict(self._merge(list(new)))
        out = []
        if not new:
            out = [sum(map(cache.__getitem__, ws)) for ws in split]
        else:
            cache.update((w, n) for w, n in fresh.items() if len(w) <= CACHE_CHARS)
            fresh = {w: n for w, n in fresh.items() if len(w) > CACHE_CHARS}
            for ws in split:
                out.append(sum(cache[w] if w in cache else fresh[w] for w in ws) if fresh else sum(map(cache.__getitem__, ws)))
        return out


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row, whole texts.

    A null text counts as empty: no bytes, no tokens. A null id stays null; repeated rows each give
    a row; an empty table gives an empty result. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def rows(batches):
        count = counter(model_path).count
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.array(count(texts), np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(rows, SCHEMA)
