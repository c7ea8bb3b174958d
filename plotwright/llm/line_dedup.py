"""Line dedup: later copies of repeated line runs are deleted.

The lines with a word, numbered within each document, are the text of a suffix array over line IDs.
Only lines that occur twice can be in a repeated run, and only stretches of such lines that hold
`MIN_WORDS` words; the rest is set aside first. Ranks come by distributed prefix doubling: the rank
of a run of 2k lines is the place of its pair of k-line ranks among all distinct pairs, sorted by
range over the cluster. A run of any length is an interval of the suffix array, named by the ranks
of its first and last power of two lines. The shortest runs of MIN_WORDS words that start, or end,
at a line are looked up this way; where such an interval has an earlier member, the run is a later
copy. Runs that overlap join to the maximal repeated run, and its lines are deleted.

No run that is looked up has more than MIN_WORDS lines, so the number of doublings does not grow
with the documents.

A line is known by two 64-bit hashes with seeds of their own: among 1e12 distinct lines two agree by
chance with one of 1e14. From there on ranks are compared, which are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, free_name, join_hot

MIN_WORDS = 50
KEY = ["doc", "hash"]


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, hash (of the text), pos (among lines with a word), raw (among all lines), id and check (of the line), words."""
    slim = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("raw"), x.alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    each = slim.select("doc", F.xxhash64("text").alias("hash"), F.posexplode(F.filter(numbered, lambda x: x["words"] > 0)).alias("pos", "x"))
    return each.select("doc", "hash", F.col("pos").cast("long").alias("pos"), "x.raw", F.xxhash64("x.line").alias("id"), F.xxhash64(F.lit(1), "x.line").alias("check"), F.col("x.words").alias("words"))


def _groups(batches):
    """Complete groups of rows that agree in the first two columns, as lists of numpy columns."""
    held: list[list[np.ndarray]] = []

    def whole():
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) if i == 0 else b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        bound = [0, *change.tolist(), b.num_rows]
        for a, z in zip(bound[:-1], bound[1:], strict=True):
            part = [c[a:z] for c in cols]
            if held and (held[-1][0][0] != part[0][0] or held[-1][1][0] != part[1][0]):
                yield whole()
                held = []
            held.append(part)
    if held:
        yield whole()


LINE = ["id", "check"]
WINDOWS = "doc long, hash long, pos long, raw int, id long, check long, ahead int, back int"


def _stretches(repeated: DataFrame, min_words: int, n_parts: int) -> DataFrame:
    """The lines of stretches that hold min_words: `ahead` lines from here, `back` lines up to here just hold them (0: none do)."""

    def rows(batches):
        for doc, name, pos, raw, ident, check, words in _groups(batches):
            start = np.flatnonzero(np.append(True, np.diff(pos) != 1))
            out = []
            for a, z in zip(start, np.append(start[1:], len(pos)), strict=True):
                total = np.concatenate([[0], np.cumsum(words[a:z], dtype=np.int64)])
                if total[-1] < min_words:
                    continue
                n = z - a
                end = np.searchsorted(total, total[:-1] + min_words)
                ahead = np.where(end <= n, end - np.arange(n), 0)
                begin = np.searchsorted(total, total[1:] - min_words, "right") - 1
                back = np.where(begin >= 0, np.arange(1, n + 1) - begin, 0)
                out.append((np.arange(a, z), ahead, back))
            if not out:
                continue
            at, ahead, back = (np.concatenate(c) for c in zip(*out, strict=True))
            ids = pa.array(doc[at], pa.int64(), mask=doc[at] == np.iinfo(np.int64).min)
            cols = [ids, *(pa.array(c[at], k) for c, k in ((name, pa.int64()), (pos, pa.int64()), (raw, pa.int32()), (ident, pa.int64()), (check, pa.int64()))), pa.array(ahead, pa.int32()), pa.array(back, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "hash", "pos", "raw", *LINE, "ahead", "back"])

    kept = repeated.select(*KEY, "pos", "raw", *LINE, "words")
    return kept.repartition(n_parts, *KEY).sortWithinPartitions(*KEY, "pos").mapInArrow(rows, WINDOWS)


def _ranked(rows: DataFrame, by: list[str], name: str, n_parts: int) -> DataFrame:
    """`rows` with `name`: the place of their `by` columns among all distinct ones, sorted by range."""
    spark = rows.sparkSession
    keys = rows.groupBy(*by).agg(F.count("*").alias("times"))
    keys = cut(keys.repartitionByRange(n_parts, *by).sortWithinPartitions(*by).withColumn("slice", F.spark_partition_id()))
    slices = keys.groupBy("slice").agg(F.count("*").alias("n"), F.sum("times").alias("times")).collect()
    sizes, total = sorted((r["slice"], r["n"]) for r in slices), sum(r["times"] for r in slices)
    offset = np.cumsum([0] + [n for _, n in sizes]).tolist()
    first = spark.createDataFrame([(s, o) for (s, _), o in zip(sizes, offset, strict=False)] or [(-1, 0)], "slice int, first long")
    place = F.row_number().over(Window.partitionBy("slice").orderBy(*by))
    ranks = keys.withColumn("place", place).join(F.broadcast(first), "slice").select(*by, (F.col("first") + F.col("place")).alias(name), "times")
    return join_hot(rows, ranks, by, "times", total)


def later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc, hash and raw (line number from 0) of every line that lies in a later copy of a run."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = cut(lines_of(docs, id_col, text_col))
    often = cut(lines.groupBy(*LINE).agg(F.count("*").alias("n")).where("n > 1"))
    # rows of one id and one text are one document
    repeated = join_hot(lines, often, LINE, "n", lines.count()).dropDuplicates([*KEY, "pos"])
    s = cut(_ranked(cut(_stretches(repeated, min_words, n_parts)), LINE, "r0", n_parts).drop(*LINE))
    longest = s.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    order, level, k = Window.partitionBy(*KEY).orderBy("pos"), 0, 1
    while 2 * k <= longest:
        next_rank = F.when(F.lead("pos", k).over(order) == F.col("pos") + k, F.lead(f"r{level}", k).over(order)).otherwise(F.lit(-1))
        s = cut(_ranked(s.withColumn("next", next_rank), [f"r{level}", "next"], f"r{level + 1}", n_parts).drop("next"))
        level, k = level + 1, 2 * k
    ranks = F.array(*[f"r{i}" for i in range(level + 1)])

    def runs(length: str, first) -> DataFrame:
        """Runs as start, number of lines, rank of the first power of two lines and of the last."""
        run = s.where(f"{length} > 0").select(*KEY, first.alias("pos"), F.col(length).alias("size"))
        power = F.floor(F.log2(F.col("size") + F.lit(0.5))).cast("int")
        return run.distinct().withColumn("power", power).withColumn("last", F.col("pos") + F.col("size") - F.pow(F.lit(2), "power").cast("long"))

    asked = runs("ahead", F.col("pos")).unionByName(runs("back", F.col("pos") - F.col("back") + 1)).distinct()
    known = s.select(*KEY, "pos", ranks.alias("ranks"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEY]
    head = asked.alias("a").join(known.alias("k"), [*same, F.col("a.pos") == F.col("k.pos")]).select("a.*", F.get("k.ranks", "a.power").alias("x"))
    both = head.alias("a").join(known.alias("k"), [*same, F.col("a.last") == F.col("k.pos")]).select("a.*", F.get("k.ranks", "a.power").alias("y"))
    both = cut(both)
    interval = ["size", "x", "y"]
    spot = F.struct(*KEY, "pos")
    earliest = cut(both.groupBy(*interval).agg(F.min(spot).alias("earliest"), F.count("*").alias("n")).where("n > 1"))
    copies = join_hot(both, earliest, interval, "n", both.count()).where(spot > F.col("earliest")).select(*KEY, F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos")).distinct()
    return copies.alias("c").join(s.alias("s"), [F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in KEY] + [F.col("c.pos") == F.col("s.pos")]).select("s.doc", "s.hash", "s.raw")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with later copies deleted from the text, and n_lines and deleted_lines (numbers from 0).

    A run is consecutive lines with a word, of one document; its copies have the same lines. It comes
    later if a copy starts before it, by id, then by text hash, then by line; copies may overlap. All
    lines of a repeated run of `min_words` words or more go, but for the first copy. Lines without a
    word are not compared and stay. Rows of one id and one text are one document and get the same
    result. A null text stays null, with no lines; null ids come first. All columns stay; extra columns
    that are named n_lines or deleted_lines are replaced. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    gone = later_lines(docs, id_col, text_col, min_words).groupBy(*KEY).agg(F.sort_array(F.collect_set("raw")).alias("deleted_lines"))
    a_doc, a_hash, cut_out = (free_name(docs, n) for n in ("_doc", "_hash", "_gone"))
    gone = gone.select(F.col("doc").alias(a_doc), F.col("hash").alias(a_hash), F.col("deleted_lines").alias(cut_out))
    kept = [c for c in docs.columns if c not in ("n_lines", "deleted_lines")]
    named = docs.select(*kept)
    joined = named.join(gone, named[id_col].cast("long").eqNullSafe(gone[a_doc]) & (F.xxhash64(named[text_col].cast("string")) == gone[a_hash]), "left")
    split = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col(cut_out), i)), "\n")
    text = F.when(F.col(cut_out).isNull(), F.col(text_col)).otherwise(left)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept], F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(cut_out, F.array().cast("array<int>")).alias("deleted_lines"))


#: The same by windows of lines written out, for small tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, text, str_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS raw, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, raw, line, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM k),
ahead AS (SELECT a.doc_id, a.pos AS first, min(b.pos) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY 1, 2),
back AS (SELECT b.doc_id, max(a.pos) AS first, b.pos AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.pos BETWEEN b.pos - 49 AND b.pos AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.pos),
runs AS (SELECT * FROM ahead UNION SELECT * FROM back),
named AS (SELECT r.doc_id, r.first, r.last, string_agg(c.line, chr(10) ORDER BY c.pos) AS run FROM runs r JOIN c ON c.doc_id = r.doc_id AND c.pos BETWEEN r.first AND r.last GROUP BY 1, 2, 3),
later AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS rn FROM named) WHERE rn > 1),
gone AS (SELECT DISTINCT c.doc_id, c.raw FROM later r JOIN c ON c.doc_id = r.doc_id AND c.pos BETWEEN r.first AND r.last),
g AS (SELECT doc_id, list(raw ORDER BY raw) AS raws FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN raws IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(raws, i)), lambda i: ls[i]), chr(10)) END AS text, coalesce(len(ls), 0)::BIGINT AS n_lines,
  coalesce(array_to_string(list_transform(raws, lambda i: i - 1), ','), '') AS deleted_lines FROM d LEFT JOIN g USING (doc_id)
"""
