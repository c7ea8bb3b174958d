"""Registry match: the nearest registry row by weighted character n-grams, and what it confirms."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import sequence_ratio
from ..functions.text import compare_key, identifier_key, normalise

# Identity score of a match, owner similarity, and tolerated differences of the area.
MATCH, OWNER, AREA_WARN, AREA_ERROR = 0.55, 0.72, 0.15, 0.50
SIZES = (2, 3)
IDENTITY = ("khasra_number", "khata_number", "village", "district")

#: Registry texts that a task holds at a time, bytes of word sums it keeps, texts that are worth a part of their own, and most parts to a partition.
BLOCK, KEPT, TEXTS, SPREAD = 32768, 64_000_000, 4096, 3


def identity(columns=IDENTITY) -> Column:
    """The identity text: the comparison forms of the identifying columns, by spaces."""
    return F.concat_ws(" ", *[compare_key(F.coalesce(F.col(c), F.lit(""))) for c in columns])


def grams(text: Column, sizes=SIZES) -> Column:
    """Character n-grams inside words padded by a space on either side; a padded word that is not longer than n is one gram."""

    def of(word: Column, n: int) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        last = F.greatest(F.length(w) - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(w, i, F.lit(n)))

    words = F.filter(F.split(text, " "), lambda x: x != "")
    return F.flatten(F.transform(words, lambda w: F.concat(*[of(w, n) for n in sizes])))


class Block:
    """A block of registry texts, scored whole against one text after the other.

    A score is a sum over the text's words, so texts in order share the sums of the words they begin with.
    """

    def __init__(self, weights: dict[str, float], texts: list[str]) -> None:
        self.n, self.ids, self.idf = len(texts), {g: k for k, g in enumerate(weights)}, np.array(list(weights.values()))
        known = {x: self.terms(x) for x in {x for text in texts for x in text.split()}}
        words = [known[x] for text in texts for x in text.split()]
        owner = np.repeat(np.repeat(np.arange(self.n), [len(text.split()) for text in texts]), [len(g) for g, _ in words])
        spots, at = np.unique(np.concatenate([g for g, _ in words]) * self.n + owner, return_inverse=True)
        gram, self.rows = np.divmod(spots, self.n)
        w = np.bincount(at, np.concatenate([c for _, c in words])) * self.idf[gram]
        self.w = w / np.sqrt(np.bincount(self.rows, w * w, self.n))[self.rows]
        self.starts = np.searchsorted(gram, np.arange(len(self.ids) + 1))
        #: of the text before: its words, and for none, one, two... of them the products with all rows, the square of its length and its n-grams
        self.words, self.sums, self.last = [], [(np.zeros(self.n), 0.0, {})], (None, 0.0)
        self.kept, self.room = {}, KEPT

    def terms(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The known n-grams of a word (see `grams`), and how often each is there."""
        w = f" {word} "
        n = Counter(w[i : i + size] for size in SIZES for i in range(max(len(w) - size + 1, 1)))
        found = [(self.ids[g], c) for g, c in n.items() if g in self.ids]
        return np.array([g for g, _ in found], np.int64), np.array([c for _, c in found], np.float64)

    def share(self, word: str) -> tuple[np.ndarray | slice, np.ndarray, list]:
        """Rows and what the word adds to their products (all rows, unless few have an n-gram of it), and its n-grams."""
        if word not in self.kept:
            g, c = self.terms(word)
            spans = [slice(self.starts[k], self.starts[k + 1]) for k in g]
            rows, adds = [self.rows[x] for x in spans], [self.w[x] * f for x, f in zip(spans, c * self.idf[g], strict=True)]
            total = np.bincount(np.concatenate(rows), np.concatenate(adds), self.n) if rows else np.zeros(self.n)
            few = np.flatnonzero(total)
            if self.room < 0:
                self.kept, self.room = {}, KEPT
            where, adds = (few, total[few]) if 8 * len(few) < self.n else (slice(None), total)
            self.kept[word] = where, adds, list(zip(g.tolist(), c.tolist(), (self.idf[g] ** 2).tolist(), strict=True))
            self.room -= 16 * len(adds) + 4096
        return self.kept[word]

    def best(self, text: str, least: float) -> tuple[int | None, float]:
        """The first of the rows most like the text, to nine digits, and its score; no row if none scores `least`."""
        words = text.split()
        if words == self.words:
            return self.last
        same = next((k for k, (x, y) in enumerate(zip(words, self.words, strict=False)) if x != y), min(len(words), len(self.words)))
        del self.sums[same + 1 :]
        for x in words[same:]:
            rows, adds, terms = self.share(x)
            total, square, there = self.sums[-1]
            total, there = total.copy(), there.copy()
            total[rows] += adds
            for g, c, w in terms:
                before = there.get(g, 0.0)
                there[g] = before + c
                square += c * (c + 2 * before) * w
            self.sums.append((total, square, there))
        dots, square, _ = self.sums[-1]
        self.words, self.last, norm, top = words, (None, 0.0), math.sqrt(square), float(dots.max())
        if norm > 0 and top > 0 and top / norm >= least:
            near = np.flatnonzero(dots >= top - 1e-8 * norm)
            score = dots[near] / norm
            near, score = near[score >= least], score[score >= least]
            k = int(np.round(score, 9).argmax())
            self.last = int(near[k]), float(score[k])
        return self.last


def best_match(records: DataFrame, registry: DataFrame, id_col: str = "id", source_col: str = "source_id", least: float = MATCH) -> DataFrame:
    """id, source_id and score of the registry row most like each record, where one scores `least`; ties go to the lowest source.

    Weights are term count times ln((1 + n) / (1 + df)) + 1 over the registry, at length one. Each distinct
    identity of the records is scored once against each distinct one of the registry, in blocks of BLOCK
    registry rows that tasks hold in memory: no pair is written, and only the best of a block leaves it.
    """
    n_parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_{c}" for c in IDENTITY]
    r = registry.select(F.col(source_col).alias("source"), identity().alias("text"))
    known = r.where("text <> ''").groupBy("text").agg(F.min("source").alias("source"), F.count("*").alias("n"))
    df = known.select("n", F.explode(F.array_distinct(grams(F.col("text")))).alias("gram")).groupBy("gram").agg(F.sum("n").alias("df"))
    idf = F.log((1 + registry.agg(F.count("*")).scalar()) / (1 + F.col("df"))) + 1
    blocks = known.agg((1 + F.floor(F.count("*") / BLOCK)).cast("int")).scalar()

    raw = records.select(id_col, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(IDENTITY, keys, strict=True)])
    texts = raw.select(keys).distinct()
    parts = texts.agg(F.least(F.lit(SPREAD * n_parts), 1 + F.floor(F.count("*") / TEXTS)).cast("int")).scalar()
    # texts that begin alike go to the same part: they share plot numbers, whose sums are the costly ones
    asked = texts.withColumn("text", identity(keys)).repartitionByRange(SPREAD * n_parts, "text").withColumn("at", F.spark_partition_id())

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kind = dict(r.dtypes)["source"]
    held = df.select(F.lit(0).alias("kind"), null(kind, "source"), F.col("gram").alias("text"), idf.alias("weight"), blocks.alias("blocks")).select("*", every("blocks").alias("block")).drop("blocks")
    held = held.unionByName(known.where("source IS NOT NULL").select(F.lit(1).alias("kind"), "source", "text", null("double", "weight"), F.pmod(F.xxhash64("text"), blocks).cast("int").alias("block")))
    held = held.withColumn("parts", parts).select("*", every("parts").alias("part"), *[null("string", k) for k in keys]).drop("parts")
    asked = asked.select(F.lit(2).alias("kind"), null(kind, "source"), "text", null("double", "weight"), *keys, F.pmod("at", parts).alias("part"), blocks.alias("blocks")).select("*", every("blocks").alias("block")).drop("blocks")

    def match(batches):
        place, weights, rows, block = None, {}, [], None
        for batch in batches:
            named = [batch.column(c).to_pylist() for c in ("part", "block", "kind", "source", "text", "weight")]
            at, out = [], []
            for k, (part, b, what, src, text, weight) in enumerate(zip(*named, strict=True)):
                if place != (part, b):
                    place, weights, rows, block = (part, b), {}, [], None
                if what == 0:
                    weights[text] = weight
                elif what == 1:
                    rows.append((src, text))
                elif rows:
                    block = block or Block(weights, [x for _, x in rows])
                    row, score = block.best(text, least)
                    if row is not None:
                        at.append(k)
                        out.append((rows[row][0], score))
            picked = batch.take(pa.array(at, pa.int64()))
            found = [pa.array([x for x, _ in out], batch.schema.field("source").type), pa.array([x for _, x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(picked.column(k) for k in keys), *found], [*keys, "source", "score"])

    met = held.unionByName(asked).repartition(n_parts, "part", "block").sortWithinPartitions("part", "block", "kind", "source", "text")
    found = met.mapInArrow(match, f"{', '.join(f'{k} string' for k in keys)}, source {kind}, score double")
    top = found.groupBy(keys).agg(F.min_by(F.struct("source", "score"), F.struct(-F.round("score", 9), F.col("source"))).alias("b"))
    return raw.join(top, keys).select(id_col, F.col("b.source").alias(source_col), "b.score")


def exact(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records joined to registry rows of the same village whose plot number is the same up to separators."""
    key = lambda c: identifier_key(F.col(c))
    r = registry.select(F.col("source_id"), compare_key(F.col("village")).alias("vk"), key("khasra_number").alias("kk"), F.col("owner_name").alias("reg_owner"), F.col("area_sqm").alias("reg_area"), F.col("land_classification").alias("reg_class")).where("kk <> ''")
    q = records.withColumn("vk", compare_key(F.col("village"))).withColumn("kk", key("khasra_number"))
    return q.join(r, ["vk", "kk"]).drop("vk", "kk")


def fact_check(matched: DataFrame, sqm: Column, fuzzy_owner: bool = True) -> DataFrame:
    """Findings per record joined to its registry row: owner, area and class; VERIFIED if nothing differs."""
    a, b = F.lower(normalise(F.col("owner_name"))), F.lower(normalise(F.col("reg_owner")))
    owner = (sequence_ratio(a, b) < OWNER) if fuzzy_owner else (a != b)
    off = F.abs(sqm - F.col("reg_area")) / F.col("reg_area")
    have = (F.coalesce(F.col("owner_name"), F.lit("")) != "") & (F.coalesce(F.col("reg_owner"), F.lit("")) != "")
    cases = F.array(
        F.when(have & owner, F.struct(F.lit("FACT_CHECK_OWNER_MISMATCH").alias("rule"), F.lit("error").alias("severity"))),
        F.when(off >= AREA_ERROR, F.struct(F.lit("FACT_CHECK_AREA_MISMATCH").alias("rule"), F.lit("error").alias("severity"))),
        F.when((off >= AREA_WARN) & (off < AREA_ERROR), F.struct(F.lit("FACT_CHECK_AREA_MISMATCH").alias("rule"), F.lit("warning").alias("severity"))),
        F.when((F.coalesce(F.col("land_classification"), F.lit("")) != "") & (F.col("land_classification") != F.col("reg_class")), F.struct(F.lit("FACT_CHECK_CLASS_MISMATCH").alias("rule"), F.lit("warning").alias("severity"))),
    )
    m = matched.withColumn("_f", F.filter(cases, lambda x: x.isNotNull()))
    fine = F.array(F.struct(F.lit("FACT_CHECK_VERIFIED").alias("rule"), F.lit("info").alias("severity")))
    return m.select("id", "source_id", F.explode(F.when(F.size("_f") > 0, F.col("_f")).otherwise(fine)).alias("f")).select("id", "source_id", "f.rule", "f.severity")
