"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled texts. Their content is chosen here and not by
zstandard's trainer: the ordinary one holds the segments (words and their beginnings) that ordinary
texts have most, the toxic one these and the segments that toxic texts have more often by a
likelihood ratio. Both begin with the ordinary segments, so a window costs the same under either
unless it holds something toxic. Dictionaries that the trainer made of toxic and of ordinary texts
were measured and found less (see the README).

Each text is cut at words into windows. A window's saving is its compressed length under the ordinary
dictionary less that under the toxic one. The threshold for a saving, and the step from a text's
savings to a score, are calibrated on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .ngram_join import text_pieces

#: The most labelled rows of a class that the models are fitted on. Of a longer text FIT_CHARS
#: characters are fitted on, in FIT_SLICES slices that lie evenly over all of it.
FIT_ROWS, FIT_CHARS, FIT_SLICES = 3000, 20_000, 100
WINDOW_WORDS, DICT_BYTES = 4, 48_000
#: The likelihood ratio from which a segment sets toxic texts apart; by chance one segment in a million has it.
EVIDENCE = 24.0
#: zstandard looks for no match that starts in the last 8 bytes of its input: windows reach that much further.
TAIL = 10
#: The share of the toxic class when the score is calibrated.
TOXIC_WEIGHT = 0.3
FOLDS = 5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EDGE = b".,;:!?\"'()"


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case and white space as spaces."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    data[(data >= 9) & (data <= 13)] = 32
    return data


def windows(data: np.ndarray, at: np.ndarray, width: int = WINDOW_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of every window: `width` words, or what is left of a text, and TAIL bytes."""
    inside = data != 32
    start = inside.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, at)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(starts)) - first[:-1][row]
    opens = np.flatnonzero(place % width == 0)
    begin = starts[opens]
    end = np.minimum(np.append(begin[1:], len(data)) + TAIL, at[1:][row[opens]])
    return begin, end - begin, row[opens]


class Compressors:
    """The two dictionaries as compressors of many windows in one call."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.both = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            logs = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 4, "min_match": 4, "strategy": zstandard.STRATEGY_GREEDY}
            params = zstandard.ZstdCompressionParameters.from_level(9, source_size=256, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0, **logs)
            d.precompute_compress(compression_params=params)
            self.both.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def savings(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        if not len(begin):
            return np.zeros(0, np.int64)
        segments = np.stack([begin, size], 1).astype(np.uint64).tobytes()
        lengths = []
        for c in self.both:
            out = c.multi_compress_to_buffer(zstandard.BufferWithSegments(data.tobytes(), segments))
            lengths.append(np.fromiter(map(len, out), np.int64, len(begin)))
        return lengths[0] - lengths[1]


def column_savings(column: pa.Array, comp: Compressors):
    """For each text the savings of its windows."""
    padded = pc.binary_join_element_wise(column.cast(pa.large_string()).fill_null(""), pa.scalar(" " * TAIL, pa.large_string()), pa.scalar("", pa.large_string()))
    for data, at in text_pieces(padded):
        data = lowered(data)
        begin, size, row = windows(data, at)
        saved = comp.savings(data, begin, size)
        yield from np.split(saved, np.searchsorted(row, np.arange(1, len(at) - 1)))


def _parts(word: bytes) -> list[bytes]:
    """A word and the leading parts that longer words share, as far as they can be segments."""
    w = word.strip(EDGE)
    return [x for x in (w, *(w[:k] for k in (5, 6, 7) if len(w) > k)) if 4 <= len(x) <= 24]


def _frequency(texts: list[bytes]) -> Counter:
    seen: Counter = Counter()
    for t in texts:
        seen.update({x for w in set(WORD.findall(t)) for x in _parts(w)})
    return seen


def _contexts(texts: list[bytes], wanted: set[bytes]) -> Counter:
    """In how many different surroundings each wanted segment stands; copies of a text count once."""
    found: set[tuple[bytes, int]] = set()
    for t in texts:
        words = WORD.findall(t)
        for i, w in enumerate(words):
            for x in _parts(w):
                if x in wanted:
                    found.add((x, hash((words[i - 1] if i else b"", words[i + 1] if i + 1 < len(words) else b""))))
    return Counter(x for x, _ in found)


def build_dictionaries(ordinary: list[bytes], toxic: list[bytes], size: int = DICT_BYTES) -> tuple[bytes, bytes]:
    """Raw dictionaries: segments that ordinary texts have most, for toxic after them what sets toxic texts apart."""
    seen_o, seen_t = _frequency(ordinary), _frequency(toxic)

    n_o, n_t = max(1, len(ordinary)), max(1, len(toxic))

    def evidence(k: int, other: int) -> float:
        """The likelihood ratio statistic that toxic texts have a segment more often."""
        mean = (k + other) / (n_o + n_t)
        if k / n_t <= 4 * other / n_o:
            return 0.0
        return 2 * (k * math.log(k / (n_t * mean)) + (other * math.log(other / (n_o * mean)) if other else 0.0))

    apart = {w for w, k in seen_t.items() if k >= 4 and evidence(k, seen_o[w]) > EVIDENCE}
    spread = _contexts(toxic, apart)
    gain = {w: len(w) * k for w in apart if evidence(k := min(seen_t[w], spread[w]), seen_o[w]) > EVIDENCE}
    best, total = [], 0
    for w in sorted(gain, key=lambda w: (-gain[w], w)):
        total += len(w) + 2
        if total > size // 2:
            break
        best.append(w)
    toxic_part = b"".join(b" " + w + b" " for w in reversed(best))
    common, total = [], 0
    for w in sorted(seen_o, key=lambda w: (-seen_o[w] * len(w), w)):
        if b" " + w in toxic_part:
            continue
        total += len(w) + 1
        if total > size // 2:
            break
        common.append(w)
    shared = b" ".join(reversed(common))
    # of one length, so that distances to the shared part cost the same
    return shared + b"\0" * len(toxic_part), shared + toxic_part


class Model:
    """Dictionaries, the saving from which a window counts, and weights of the score."""

    def __init__(self, ordinary: bytes, toxic: bytes, threshold: int, w: list[float]):
        self.dicts, self.threshold, self.w = (ordinary, toxic), threshold, w

    def features(self, saved: np.ndarray) -> list[float]:
        if not len(saved):
            return [1.0, 0.0, 0.0, 0.0]
        over = int((saved >= self.threshold).sum())
        return [1.0, math.log1p(over), float(min(saved.max(), 12)) / 4, 10 * over / (len(saved) + 5)]

    def score(self, saved: np.ndarray) -> float:
        z = sum(a * b for a, b in zip(self.w, self.features(saved), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(ordinary: list[str], toxic: list[str]) -> Model:
    """A model from labelled texts: even places build the dictionaries, odd places calibrate.

    Without texts of both classes every score is the share of toxic texts (a half if there are none).
    """
    raw = [[lowered(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)).tobytes() for t in texts] for texts in (ordinary, toxic)]
    if not ordinary or not toxic:
        share = (len(toxic) + 0.5) / (len(ordinary) + len(toxic) + 1)
        return Model(b"", b"", 1, [math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    dicts = build_dictionaries(raw[0][::2], raw[1][::2])
    comp = Compressors(*dicts)
    probe = [list(column_savings(pa.array([t.decode("utf-8", "replace") for t in texts[1::2] or texts]), comp)) for texts in raw]
    y = np.array([0] * len(probe[0]) + [1] * len(probe[1]))
    saved = probe[0] + probe[1]
    best, threshold = -1.0, 1
    for t in range(1, 13):
        share = np.array([np.count_nonzero(s >= t) > 0 for s in saved])
        quality = share[y == 1].mean() - share[y == 0].mean()
        if quality > best + 1e-9:
            best, threshold = quality, t
    model = Model(*dicts, threshold, [0.0] * 4)
    x = np.array([model.features(s) for s in saved])
    w, weight = np.zeros(4), np.where(y == 1, TOXIC_WEIGHT / max(1, (y == 1).sum()), (1 - TOXIC_WEIGHT) / max(1, (y == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - y) * weight) + 1e-4 * w
        hess = (x * (p * (1 - p) * weight)[:, None]).T @ x + 1e-4 * np.eye(4)
        w -= np.linalg.solve(hess, grad)
    model.w = w.tolist()
    return model


def held_out(id_col) -> object:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most `fit_rows` labelled rows of each class that are not held out.

    Rows are chosen by a hash of the id; a document with several labels counts as toxic if one says
    so. Of a text over FIT_CHARS evenly spread slices are fitted on; all texts are scored whole.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sets = []
    for value in (0, 1):
        ids = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("doc_id")
        text = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")
        width, last = FIT_CHARS // FIT_SLICES, F.length("text") - FIT_CHARS // FIT_SLICES
        slices = F.transform(F.sequence(F.lit(0), F.lit(FIT_SLICES - 1)), lambda k: F.substr("text", (k * last / (FIT_SLICES - 1)).cast("int") + 1, F.lit(width)))
        text = text.withColumn("text", F.when(F.length("text") <= FIT_CHARS, F.col("text")).otherwise(F.array_join(slices, " ")))
        # at most fit_rows ids of 8 bytes
        rows = text.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).collect()
        sets.append([r.text for r in sorted(rows, key=lambda r: r.doc_id)])
    return fit(*sets)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row, over its whole text.

    A null, empty or wordless text has no windows and gets the score of a text that saves nothing. A
    null id stays null and is not held out; repeated rows each give a row; other columns are not read;
    an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def rows(batches):
        comp = Compressors(*model.dicts)
        for b in batches:
            score = np.array([model.score(s) for s in column_savings(b.column(2), comp)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ids = docs[id_col].cast("long")
    return docs.select(ids.alias("doc_id"), held_out(ids).alias("held_out"), docs[text_col].cast("string").alias("text")).mapInArrow(rows, SCHEMA)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model does not call toxic, with all their columns, without a shuffle."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def rows(batches):
        comp = Compressors(*model.dicts)
        for b in batches:
            keep = [model.score(s) < 0.5 for s in column_savings(b.column(place), comp)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
