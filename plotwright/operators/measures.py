"""Measures of scans, prints, footprints and extraction quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Plausible heights, least samples, and the marks of legibility.
HEIGHT_LOW, HEIGHT_HIGH, LEAST_SAMPLES, BUILT_M, BUILT_SHARE = 0.0, 400.0, 8, 0.5, 0.1
GATE_LOW, GATE_HIGH, GATE_FLOOR = 32.0, 62.0, 0.55
LEGIBILITY = {"sharpness": 0.32, "contrast": 0.28, "ink": 0.16, "skew": 0.10, "illumination": 0.08, "bleed": 0.06}


def height_stats(samples: DataFrame, key: str = "footprint_id", value: str = "height_m") -> DataFrame:
    """Per footprint the highest, 95th percentile, median and mean height, the built share, samples and dropped ones; null measures under LEAST_SAMPLES."""
    v, fine = F.col(value), F.col(value).between(HEIGHT_LOW, HEIGHT_HIGH)
    g = samples.groupBy(key).agg(F.array_sort(F.collect_list(F.when(fine, v))).alias("h"), F.sum(F.when(fine, 0).otherwise(1)).alias("dropped"))
    n = F.size("h")

    def at(q: float) -> Column:
        return F.round(F.get("h", F.least(n - 1, F.floor(n * q).cast("int"))), 2)

    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    built = F.round(F.size(F.filter("h", lambda x: x > BUILT_M)) / n, 3)
    enough = n >= LEAST_SAMPLES
    out = [F.when(enough, c).alias(k) for k, c in (("max_m", F.round(F.get("h", n - 1), 2)), ("p95_m", at(0.95)), ("median_m", at(0.5)), ("mean_m", F.round(total / n, 2)), ("built_fraction", built))]
    return g.select(key, *out, n.cast("long").alias("samples"), F.col("dropped").cast("long").alias("dropped")).withColumn("height_m", F.when(F.col("built_fraction") >= BUILT_SHARE, F.col("p95_m")))


def quality_gate(score: Column) -> Column:
    """How far a page's legibility lets its reading be trusted: 1 from 62 on, 0.55 up to 32, linear between."""
    return F.when(score >= GATE_HIGH, 1.0).when(score <= GATE_LOW, GATE_FLOOR).otherwise((score - GATE_LOW) / (GATE_HIGH - GATE_LOW) * (1 - GATE_FLOOR) + GATE_FLOOR)


def gate_label(score: Column) -> Column:
    return F.when(score >= GATE_HIGH, "ok").when(score <= GATE_LOW, "poor").otherwise("marginal")


def legibility(parts: dict[str, Column]) -> Column:
    """Weighted sum of the parts, each held between 0 and 1, as points."""
    return F.round(sum((F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * LEGIBILITY[k] for k, c in parts.items()), F.lit(0.0)) * 100, 1)


def line_confidence(words: DataFrame, keys: list[str], conf: str) -> DataFrame:
    """Per line the geometric mean of its words' confidences, at least 0.01 each, at most 1."""
    return words.groupBy(*keys).agg(F.count("*").alias("words"), F.round(F.least(F.lit(1.0), F.exp(F.avg(F.log(F.greatest(F.col(conf), F.lit(0.01)))))), 4).alias("confidence"))


def reading_summary(words: DataFrame, key: str, text: str = "text", conf: str = "conf", sure: float = 50.0) -> DataFrame:
    """Per page the mean confidence of its words and the characters of the sure ones; blank words and unread ones (under 0) do not count."""
    word = F.trim(F.coalesce(F.col(text), F.lit("")))
    read = (word != "") & (F.col(conf) >= 0)
    certain = (word != "") & (F.col(conf) >= sure)
    return words.groupBy(key).agg(F.round(F.coalesce(F.avg(F.when(read, F.col(conf))), F.lit(0.0)), 6).alias("mean_confidence"), F.coalesce(F.sum(F.when(certain, F.length(word))), F.lit(0)).cast("long").alias("confident_chars"))


def gap_segments(boxes: DataFrame, key: str, multiple: float = 3.0) -> DataFrame:
    """Boxes (x, w) of a line split where the gap is far over the line's median positive gap; seg counts from 0."""
    w = Window.partitionBy(key).orderBy("x", "box_id")
    b = boxes.withColumn("gap", F.greatest(F.lit(0.0), F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)))
    m = b.where("gap > 0").groupBy(key).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    j = b.join(m, key, "left")
    new = F.when(F.col("gap") > F.col("median_gap") * multiple, 1).otherwise(0)
    return j.withColumn("seg", F.sum(new).over(w))


def print_profile(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, deviation with a floor, and quantiles of a feature."""
    mean, std = F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    q = [F.round(F.percentile(value, F.lit(p)), 6).alias(f"q{int(p * 1000)}") for p in (0.5, 0.95, 0.995)]
    return samples.groupBy(key).agg(F.count("*").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.greatest(std, F.abs(mean) * 0.05, F.lit(1e-3)), 6).alias("std"), *q)


def print_score(values: DataFrame, profile: DataFrame, key: str, value: str) -> DataFrame:
    """Each value's z-score and whether it exceeds the 99.5 % quantile of print; only too much counts."""
    j = values.join(profile, key)
    return j.withColumn("z", F.round((F.col(value) - F.col("mean")) / F.col("std"), 2)).withColumn("suspected", (F.col(value) > F.col("q995")) & (F.col("q995") > F.col("q500")))


def _sums() -> dict[str, Column]:
    """Sums over control points that the normal equations are made of."""
    return {n: F.sum(e) for n, e in {"n": F.lit(1.0), "x": F.col("px"), "y": F.col("py"), "xx": F.col("px") * F.col("px"), "xy": F.col("px") * F.col("py"), "yy": F.col("py") * F.col("py"), "u": F.col("lon"), "xu": F.col("px") * F.col("lon"), "yu": F.col("py") * F.col("lon"), "v": F.col("lat"), "xv": F.col("px") * F.col("lat"), "yv": F.col("py") * F.col("lat")}.items()}


def _solved(c: dict[str, Column]) -> tuple[Column, list[Column]]:
    """The determinant of the normal equations and a to f of their solution."""

    def det(a, b, d, e, f, h, i, j, k):  # noqa: PLR0913
        return a * (f * k - h * j) - b * (e * k - h * i) + d * (e * j - f * i)

    whole = det(c["xx"], c["xy"], c["x"], c["xy"], c["yy"], c["y"], c["x"], c["y"], c["n"])

    def solve(p, q, r):
        return (det(p, c["xy"], c["x"], q, c["yy"], c["y"], r, c["y"], c["n"]) / whole, det(c["xx"], p, c["x"], c["xy"], q, c["y"], c["x"], r, c["n"]) / whole, det(c["xx"], c["xy"], p, c["xy"], c["yy"], q, c["x"], c["y"], r) / whole)

    lon, lat = solve(c["xu"], c["yu"], c["u"]), solve(c["xv"], c["yv"], c["v"])
    return whole, [*lon, *lat]


def _square() -> Column:
    """The square of a point's distance from where the fit puts it, in degrees."""
    return F.pow(F.col("a") * F.col("px") + F.col("b") * F.col("py") + F.col("c") - F.col("lon"), F.lit(2)) + F.pow(F.col("d") * F.col("px") + F.col("e") * F.col("py") + F.col("f") - F.col("lat"), F.lit(2))


def control_fit(points: DataFrame, key: str) -> DataFrame:
    """Least-squares affine of control points (px, py, lon, lat) per sheet, by normal equations, and its RMS in metres."""
    s = _sums()
    g = points.groupBy(key).agg(*[c.alias(f"s_{n}") for n, c in s.items()]).where("s_n >= 3")
    whole, solution = _solved({n: F.col(f"s_{n}") for n in s})
    fit = g.where(F.abs(whole) > 1e-12).select(key, *[x.alias(n) for n, x in zip("abcdef", solution, strict=True)])
    rms = points.join(fit, key).groupBy(key).agg((F.sqrt(F.avg(_square())) * 110_540.0).alias("rms_m"))
    return fit.join(rms, key)


#: The most metres that control points may be off by, and the fewest points that can show a bad one.
CONTROL_RMS_M, CONTROL_REDUNDANT = 2.0, 4


def control_fit_robust(points: DataFrame, key: str, max_rms_m: float = CONTROL_RMS_M, most: int = 8) -> DataFrame:
    """`control_fit` without its worst points: while a sheet's RMS is over the limit and it has more than four points, the worst goes.

    `points` has an id within the sheet. One point of every bad sheet goes a round, at most `most`
    rounds; the result has dropped, the number of points left out, and whether the fit passed.
    """
    w = Window.partitionBy(key)

    def fitted(rows: DataFrame) -> DataFrame:
        """Rows of the sheets that have a fit, with it, the point's own error and the sheet's, all within one shuffle by sheet."""
        sums = _sums()
        whole, solution = _solved({n: F.col(f"_s_{n}") for n in sums})
        s = rows.select("*", *[c.over(w).alias(f"_s_{n}") for n, c in sums.items()])
        fit = s.where((F.col("_s_n") >= 3) & (F.abs(whole) > 1e-12)).select(*rows.columns, *[x.alias(n) for n, x in zip("abcdef", solution, strict=True)])
        r2 = fit.withColumn("_r2", _square())
        return r2.withColumn("_rms", F.sqrt(F.avg("_r2").over(w)) * 110_540.0)

    used = points.where(F.col(key).isNotNull()).withColumn("_dropped", F.lit(0))
    for _ in range(most):
        worst = F.row_number().over(w.orderBy(F.desc(F.round(F.sqrt("_r2"), 12)), "point_id"))
        j = fitted(used).withColumn("_n", F.count("*").over(w)).withColumn("_rank", worst)
        bad = (F.col("_rms") > max_rms_m) & (F.col("_n") > CONTROL_REDUNDANT)
        used = j.withColumn("_dropped", F.col("_dropped") + F.when(bad, 1).otherwise(0)).where(~bad | (F.col("_rank") > 1)).select(*points.columns, "_dropped")
    fit = [F.first(n).alias(n) for n in "abcdef"]
    g = fitted(used).groupBy(key).agg(*fit, F.first("_rms").alias("rms_m"), F.max("_dropped").alias("dropped"), F.count("*").alias("points"))
    return g.withColumn("passed", F.col("rms_m") <= max_rms_m)


def robust_outliers(rows: DataFrame, value: str, key: str, cut: float = 3.5) -> DataFrame:
    """Rows with their robust z-score (distance to the group's median over its median deviation) and whether it is over `cut`."""
    m = rows.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    d = rows.join(m, key).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    s = d.groupBy(key).agg(F.percentile("dev", F.lit(0.5)).alias("mad"))
    z = F.when(F.col("mad") > 0, F.col("dev") * 0.6745 / F.col("mad")).otherwise(0.0)
    return d.join(s, key).withColumn("robust_z", F.round(z, 4)).withColumn("anomalous", z > cut)


def accuracy(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """correct, wrong, missed and spurious per field_key, with precision and recall."""
    j = truth.withColumnRenamed("value", "t").join(found.withColumnRenamed("value", "f"), keys, "full")
    outcome = F.when(F.col("t").isNull() & F.col("f").isNull(), "none").when(F.col("f").isNull(), "missed").when(F.col("t").isNull(), "spurious").when(F.col("t") == F.col("f"), "correct").otherwise("wrong")
    g = j.withColumn("o", outcome).groupBy("field_key").agg(*[F.sum(F.when(F.col("o") == k, 1).otherwise(0)).cast("long").alias(k) for k in ("correct", "wrong", "missed", "spurious")])
    tried, present = F.col("correct") + F.col("wrong") + F.col("spurious"), F.col("correct") + F.col("wrong") + F.col("missed")
    return g.withColumn("precision", F.when(tried > 0, F.round(F.col("correct") / tried, 4))).withColumn("recall", F.when(present > 0, F.round(F.col("correct") / present, 4)))
