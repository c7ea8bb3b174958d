"""Decisions about scanned pages, once their measures are a table: rows, languages, seals, regions, digits, tiles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from math import frexp, isfinite

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import cells

# Bounds of maps, seals, signatures and parcel regions, and margins of the choices.
MAP_SIDE, MAP_WHITE, MAP_INK = 200, 0.55, 0.40
SEAL_AREA, SEAL_ASPECT, SIGNATURE_INK = (4000.0, 60000.0), 0.45, (0.003, 0.35)
REGION_LEAST, REGION_PAGE, REGION_MEDIAN, NESTED = 2000, 0.9, 4.0, 0.8
ENGLISH_MARGIN, ROW_REACH, DIGIT_OVERLAP, DIGIT_IOU = 10.0, 0.55, 0.6, 0.5
SUSPECT_CAP = 0.35


def parcel_map_like(side: Column, white: Column) -> Column:
    """Whether an image is a line map: large enough, mostly white, little ink."""
    return (side >= MAP_SIDE) & (white >= MAP_WHITE) & (1 - white <= MAP_INK)


def is_seal(area: Column, width: Column, height: Column) -> Column:
    return area.between(*SEAL_AREA) & (height > 0) & (F.abs(F.try_divide(width, height) - 1) <= SEAL_ASPECT)


def is_signature(ink: Column) -> Column:
    return ink.between(*SIGNATURE_INK)


def stamp_paper(text: Column) -> Column:
    return F.upper(F.coalesce(text, F.lit(""))).rlike("NON[ -]JUDICIAL")


def lonlat_fits(x0: Column, y0: Column, x1: Column, y1: Column, projected: Column) -> Column:
    """null if a box can be degrees, else why not."""
    return F.when(projected, "projected").when((x0 < -180) | (x1 > 180) | (y0 < -90) | (y1 > 90), "out of range").when((x0 > x1) | (y0 > y1), "reversed")


def _rows_of(fragments: list[tuple[float, float, float, str]]) -> list[str]:
    """Texts of the rows of one page; its fragments (x0, y0, y1, text) come from the top.

    Rows that end well above a fragment are done with, for no later one can reach them; where a box is
    upside down that does not hold, and all rows stay open.
    """
    rows: list[list[tuple[float, float, float, str]]] = []
    live: list[list[tuple[float, float, float, str]]] = []
    ordered = all(f[2] >= f[1] for f in fragments)
    sweep = 16
    for f in fragments:
        _, y0, y1, _ = f
        if ordered and len(live) > sweep:
            live = [r for r in live if r[0][2] >= y0 - 1.0]
            sweep = max(16, 2 * len(live))
        for row in live:
            a = row[0]
            if abs((y0 + y1) - (a[1] + a[2])) / 2 <= max(1.0, min(y1 - y0, a[2] - a[1])) * ROW_REACH:
                row.append(f)
                break
        else:
            row = [f]
            rows.append(row)
            live.append(row)
    return [" ".join(" ".join(f[3] for f in (sorted(r, key=lambda f: f[0]) if len(r) > 1 else r)).split()) for r in rows]


def visual_rows(words: DataFrame, key: str) -> DataFrame:
    """Fragments (x0, y0, x1, y1, text) of each page as rows of text.

    From the top, a fragment joins the first row whose first fragment's middle is within 0.55 of the
    lower height. The order decides, so a page is one task; pages stream through it in batches of rows.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, kind = None, [], None
        pages, numbers, texts = [], [], []

        def close() -> None:
            out = _rows_of(held)
            pages.extend([page] * len(out))
            numbers.extend(range(len(out)))
            texts.extend(out)

        for b in batches:
            kind = b.column(key).type
            boxes = [b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("x0", "y0", "y1")]
            for k, *f in zip(b.column(key).to_pylist(), *boxes, b.column("text").to_pylist(), strict=True):
                if held and k != page:
                    close()
                    held = []
                page = k
                held.append(f)
            if pages:
                yield pa.RecordBatch.from_arrays([pa.array(pages, kind), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=[key, "line_no", "text"])
                pages, numbers, texts = [], [], []
        if held:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(pages, kind), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=[key, "line_no", "text"])

    w = words.select(key, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "y1")], F.coalesce("text", F.lit("")).alias("text"))
    # tenths as numpy rounds them
    top = (F.rint(F.col("y0") * 10) / 10).asc_nulls_last()
    ordered = w.repartition(key).sortWithinPartitions(key, top, F.col("x0").asc_nulls_last(), "text", "y0", "y1")
    return ordered.mapInArrow(fold, f"{key} {dict(words.dtypes)[key]}, line_no int, text string")


def choose_language(trials: DataFrame, key: str) -> DataFrame:
    """The language with the best trial (lang, score) of each image; English stays unless beaten by the margin. Ties go by name."""
    g = trials.groupBy(key).agg(F.min_by(F.struct("lang", "score"), F.struct(-F.col("score"), F.col("lang"))).alias("b"), F.max(F.when(F.col("lang") == "eng", F.col("score"))).alias("eng"))
    kept = (F.col("b.lang") != "eng") & F.col("eng").isNotNull() & (F.col("b.score") - F.col("eng") < ENGLISH_MARGIN)
    return g.select(key, F.when(kept, "eng").otherwise(F.col("b.lang")).alias("lang"), F.round("b.score", 2).alias("best_score"), F.coalesce(kept, F.lit(False)).alias("gated"))


def plausible_regions(regions: DataFrame, key: str, page_area: Column) -> DataFrame:
    """Regions (area) that can be parcels: not tiny, not the page, not far over the sheet's median."""
    sized = regions.where((F.col("area") >= REGION_LEAST) & (F.col("area") <= page_area * REGION_PAGE))
    m = sized.groupBy(key).agg(F.percentile("area", F.lit(0.5)).alias("median_area"))
    return sized.join(m, key).where(F.col("area") <= F.col("median_area") * REGION_MEDIAN).drop("median_area")


def _kept_boxes(boxes: Iterable[tuple]) -> list:
    """Ids of the boxes (id, x0, y0, x1, y1) that do not lie for over NESTED in one kept before.

    A box that holds over half of another holds its middle. Kept boxes are filed by the powers of two
    of their sides, in the four cells at most that each touches at that grain, so a box meets only those around its middle.
    """
    kept: list = []
    at: dict[tuple, list[tuple[float, float, float, float]]] = {}
    grains: set[tuple[float, float]] = set()
    vast = []
    for name, x0, y0, x1, y1 in boxes:
        w, h = x1 - x0, y1 - y0
        limit = NESTED * w * h
        if limit < 0:
            # one side is turned round: it shares nothing, which is over a negative part of it
            if not kept:
                kept.append(name)
            continue
        if w > 0 and h > 0:
            mx, my = x0 + w / 2, y0 + h / 2
            near = chain(vast, *(at.get((gx, gy, mx // gx, my // gy), ()) for gx, gy in grains)) if isfinite(mx) and isfinite(my) else chain(vast, *at.values())
            if any(max(0.0, min(x1, k[2]) - max(x0, k[0])) * max(0.0, min(y1, k[3]) - max(y0, k[1])) > limit for k in near):
                continue
            box = (x0, y0, x1, y1)
            if isfinite(w) and isfinite(h):
                gx, gy = 2.0 ** frexp(w)[1], 2.0 ** frexp(h)[1]
                grains.add((gx, gy))
                for cell in {(gx, gy, i // gx, j // gy) for i in (x0, x1) for j in (y0, y1)}:
                    at.setdefault(cell, []).append(box)
            else:
                vast.append(box)
        kept.append(name)
    return kept


def drop_nested(masks: DataFrame, key: str) -> DataFrame:
    """Boxes that do not lie for over 0.8 in a larger kept one; largest first, so a sheet is one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_a=(pdf["x1"] - pdf["x0"]) * (pdf["y1"] - pdf["y0"])).sort_values(["_a", "mask_id"], ascending=[False, True])
        kept = _kept_boxes(zip(*(pdf[c].tolist() for c in ("mask_id", "x0", "y0", "x1", "y1")), strict=True))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(kept), "mask_id": kept})

    kinds = dict(masks.dtypes)
    return masks.select(key, "mask_id", "x0", "y0", "x1", "y1").groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, mask_id {kinds['mask_id']}")


def subject_label(labels: DataFrame, key: str) -> DataFrame:
    """The label (x, y, text) nearest to its sheet's centre (cx, cy); ties go by text."""
    d = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    return labels.groupBy(key).agg(F.min_by("text", F.struct(d, F.col("text"))).alias("subject"), F.count("*").alias("labels"))


def with_digits(text: Column, runs: Column) -> Column:
    """A text with its runs of digits replaced, in order."""
    parts = F.split(text, "[0-9]+", -1)
    return F.array_join(F.zip_with(parts, F.concat(runs, F.array(F.lit(""))), lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")


def repair_digits(primary: DataFrame, digits: DataFrame) -> DataFrame:
    """Lines (page, line_no, text, box) with the digits that a second reading of the same place gives.

    The second line has as many runs of digits, shares most of the height and half of the width;
    the one that shares most height wins, then the first. Without one the line stays. Boxes without height match nothing.
    Lines meet by place within the page, not all with all.
    """
    runs = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    columns = ("line_no", "x0", "y0", "x1", "y1", "text")

    def sized(lines: DataFrame, mark: str) -> DataFrame:
        """Lines with digits, their number of runs, and the power of two over their height."""
        named = lines.select("page", F.size(runs(F.col("text"))).alias("n"), *[F.col(c).alias(f"{mark}_{c}") for c in columns])
        height = F.col(f"{mark}_y1") - F.col(f"{mark}_y0")
        return named.where((F.col("n") > 0) & (height > 0)).withColumn(f"{mark}_grain", F.pow(F.lit(2.0), F.floor(F.log2(height)) + 1))

    def meet(low: DataFrame, a: str, high: DataFrame, b: str, on: Column) -> DataFrame:
        """Pairs of lines of which the one of `high` holds the middle of the one of `low`: a line that is higher and shares over half of the lower one does.

        A line lies in two cells of its grain at most; the middle of the other is looked up at each grain of the page.
        """
        at = lambda v: F.floor(v / F.col("grain"))
        grains = high.groupBy("page").agg(F.collect_set(f"{b}_grain").alias("grains"))
        middle = low.join(grains, "page").withColumn("grain", F.explode("grains")).drop("grains").where(F.col("grain") >= F.col(f"{a}_grain"))
        middle = middle.withColumn("cell", at(F.col(f"{a}_y0") + (F.col(f"{a}_y1") - F.col(f"{a}_y0")) / 2))
        held = high.withColumn("grain", F.col(f"{b}_grain")).withColumn("cell", F.explode(F.sequence(at(F.col(f"{b}_y0")), at(F.col(f"{b}_y1")))))
        return middle.join(held.hint("merge"), ["page", "n", "grain", "cell"]).where(on)

    p, d = sized(primary, "p"), sized(digits, "d")
    p_high, d_high = F.col("p_y1") - F.col("p_y0"), F.col("d_y1") - F.col("d_y0")
    j = meet(p, "p", d, "d", p_high <= d_high).unionByName(meet(d, "d", p, "p", d_high < p_high))
    tall = (F.least("p_y1", "d_y1") - F.greatest("p_y0", "d_y0")) / F.least(p_high, d_high)
    wide = F.try_divide(F.greatest(F.lit(0.0), F.least("p_x1", "d_x1") - F.greatest("p_x0", "d_x0")), F.greatest("p_x1", "d_x1") - F.least("p_x0", "d_x0"))
    best = j.where((tall >= DIGIT_OVERLAP) & (wide >= DIGIT_IOU)).groupBy("page", F.col("p_line_no").alias("line_no")).agg(F.min_by("d_text", F.struct(-tall, F.col("d_line_no"))).alias("second"))
    out = primary.join(best, ["page", "line_no"], "left")
    fixed = F.when(F.col("second").isNotNull(), with_digits(F.col("text"), runs(F.col("second")))).otherwise(F.col("text"))
    return out.select("page", "line_no", fixed.alias("text"), (fixed != F.col("text")).alias("changed"))


def trim_overrun(text: Column, width: Column, height: Column, per_height: float = 0.9, least: int = 6) -> Column:
    """A reading cut, at a word, to what a crop of this shape can hold; the first word always stays."""
    limit = F.greatest(F.lit(least), F.floor(F.try_divide(width, height) * per_height).cast("int") + 2)

    def step(acc: Column, w: Column) -> Column:
        longer = F.when(acc["out"] == "", w).otherwise(F.concat_ws(" ", acc["out"], w))
        fits = ~acc["full"] & ((acc["out"] == "") | (F.length(longer) <= limit))
        return F.struct(F.when(fits, longer).otherwise(acc["out"]).alias("out"), (~fits).alias("full"))

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
    return F.when(F.length(text) <= limit, text).otherwise(F.aggregate(F.split(F.trim(text), r"\s+"), start, step)["out"])


def handwritten_confidence(confidence: Column, suspected: Column) -> Column:
    """Reading confidence, held low where handwriting is suspected."""
    return F.when(suspected, F.least(confidence, F.lit(SUSPECT_CAP))).otherwise(confidence)


def covering_tile(points: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """The tile (tile_id, x0, y0, x1, y1) over each point (point_id, x, y), the lowest if several are; a point on an upper edge is outside."""
    p = points.withColumn("cx", F.floor(F.col("x") / size).cast("long")).withColumn("cy", F.floor(F.col("y") / size).cast("long"))
    t = cells(tiles, size)
    j = p.join(t, ["cx", "cy"]).where("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    return j.groupBy("point_id").agg(F.min("tile_id").alias("tile_id"))


def newest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with their place from the newest, per key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
