"""BPE encoding and decoding under a word-level vocabulary file, by batched numpy merge rounds.

The file names the steps: NFC, white space to one space, lower case; words, single digits and runs
of other signs by pattern; bytes as printable characters; merges with a word-end mark. Special
tokens in a text stand for themselves, as the file's library takes them by default.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import PairTable, merge
from .common import bounded_batches

CACHE_WORDS, CACHE_CHARS = 250_000, 64
MERGE_SYMBOLS = 800_000
SPACE = r"\t-\r \x85\xa0  -     　"
CODES_SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class WordCodec:
    """Encodes texts to ids and ids to texts as the file's library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (vocab | self.special).items()}
        split = regex.escape
        self.cut = regex.compile("(" + "|".join(split(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+").findall
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right, merged = zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], strict=True)
        self.pairs = PairTable(left, right, range(len(merges)), merged, max(self.token) + 1)
        alphabet = byte_alphabet()
        self.byte = np.array([vocab[c] for c in alphabet])
        self.last = np.array([vocab[c + self.end] for c in alphabet])
        self.cache: dict[str, tuple[str, str, int]] = {}

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # lower case letter by letter: no word-final form of sigma
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def words(self, text: str) -> list[str]:
        """The text's words; a special token is a word of its own."""
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return self.word(self._normal(text))
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += ["\0" + part] if k % 2 else self.word(self._normal(part))
        return out

    def _merge(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        while words:
            part, raw, total = [], [], 0
            while words and total < MERGE_SYMBOLS:
                part.append(words.pop())
                raw.append(part[-1].encode("utf-8", "surrogatepass"))
                total += len(raw[-1])
            data = np.frombuffer(b"".join(raw), np.uint8)
            lengths = np.fromiter(map(len, raw), np.int64, len(raw))
            flat = self.byte[data]
            ends = np.cumsum(lengths) - 1
            flat[ends] = self.last[data[ends]]
            sym, left = merge(flat, lengths, self.pairs)
            sym, at = sym.tolist(), 0
            for w, n in zip(part, left.tolist(), strict=True):
                yield w, sym[at : at + n]
                at += n

    def coded(self, texts: list[str]) -> Iterator[list[tuple[str, str, int]]]:
        """For each text its words' (ids joined, tokens joined, number of ids)."""
        split = [self.words(t) for t in texts]
        cache = self.cache
        new = {w for ws in split for w in ws if w not in cache}
        if len(cache) + len(new) > CACHE_WORDS:
            # the words of this batch stay: they hold the frequent ones
            used = {w: cache[w] for ws in split for w in ws if w in cache}
            cache.clear()
            cache.update(used)
        fresh: dict[str, tuple[str, str, int]] = {}
        for w in [w for w in new if w[0] == "\0" and w[1:] in self.special]:
            new.discard(w)
            fresh[w] = (str(self.special[w[1:]]), w[1:], 1)
        for w, ids in self._merge(list(new)):
            kept = cache if len(w) <= CACHE_CHARS else fresh
            kept[w] = (" ".join(map(str, ids)), self.decode(ids), len(ids))
        for ws in split:
            yield [fresh[w] if w in fresh else cache[w] for w in ws] if fresh else list(map(cache.__getitem__, ws))

    def decode(self, ids) -> str:
        """The text of `ids`, special tokens included; the file has no decoder, so tokens are joined by one space."""
        return " ".join([self.token[i] for i in ids if i in self.token])


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text decoded from them, for every row and its whole text.

    A null text counts as empty: no ids, an empty decoded text. A null id stays null; repeated rows
    each give a row; an empty table gives an empty result. Other columns are not read.
    """

    def rows(batches):
        c = codec(path)
        for b in batches:
            ids, text = [], []
            for ws in c.coded([t or "" for t in b.column(1).to_pylist()]):
                ids.append([int(i) for w in ws for i in w[0].split(" ")])
                text.append(" ".join([w[1] for w in ws]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return _slim(docs, id_col, text_col).mapInArrow(rows, CODES_SCHEMA)


def code_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of `encode_decode`, made where the codes are, so that no code leaves its task."""

    def sha(parts) -> str:
        return hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()

    def rows(batches):
        c = codec(path)
        for b in batches:
            n, ids, text = [], [], []
            for ws in c.coded([t or "" for t in b.column(1).to_pylist()]):
                n.append(sum([w[2] for w in ws]))
                ids.append(sha([w[0] for w in ws]))
                text.append(sha([w[1] for w in ws]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _slim(docs, id_col, text_col).mapInArrow(rows, DIGEST_SCHEMA)
