"""Parcel topology: overlaps, slivers, containments, unsnapped corners and snapping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from .spatial import pairs


def with_box(parcels: DataFrame, ring: str = "ring") -> DataFrame:
    b = g.bbox(F.col(ring))
    return parcels.select("*", *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])


def overlaps(parcels: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """a, b (a < b by parcel_id) and severity of parcels that share interior but do not contain each other."""
    return _overlaps(parcels, size, keys).select("a", "b", "severity")


def _overlaps(parcels: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """`overlaps` with the keys that both parcels have."""
    kind = g.overlap_kind(F.col("a.ring"), F.col("b.ring"))
    found = pairs(parcels, parcels, F.col("a.parcel_id") < F.col("b.parcel_id"), size, keys)
    graded = found.select(*_shared(keys), F.col("a.parcel_id").alias("a_id"), F.col("b.parcel_id").alias("b_id"), kind.alias("severity"))
    return graded.where("severity IS NOT NULL").withColumnsRenamed({"a_id": "a", "b_id": "b"})


def _shared(keys: list[str] | None) -> list[Column]:
    return [F.col(f"a.{k}").alias(k) for k in keys or []]


def _clip(points: list[tuple[float, float]], a, b) -> list[tuple[float, float]]:
    """The part of a convex polygon on the left of the line from a to b."""
    out = []
    side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for x, y in points]
    for k, (p, s) in enumerate(zip(points, side, strict=True)):
        q, t = points[k - 1], side[k - 1]
        if (s < 0) != (t < 0):
            w = t / (t - s)
            out.append((q[0] + w * (p[0] - q[0]), q[1] + w * (p[1] - q[1])))
        if s >= 0:
            out.append(p)
    return out


def _fan(ring) -> list[tuple[float, list[tuple[float, float]]]]:
    """Triangles from the first corner, counter-clockwise, with the sign that each had: their signed sum is the ring."""
    p = [(q["x"], q["y"]) for q in ring]
    out = []
    for b, c in zip(p[1:-1], p[2:], strict=True):
        twice = (b[0] - p[0][0]) * (c[1] - p[0][1]) - (b[1] - p[0][1]) * (c[0] - p[0][0])
        if twice:
            out.append((1.0 if twice > 0 else -1.0, [p[0], b, c] if twice > 0 else [p[0], c, b]))
    return out


def common_area(a, b) -> float:
    """Area that two simple rings share, whatever their shape: signed triangles of one clipped by those of the other."""
    total = 0.0
    for s, t in _fan(a):
        for u, v in _fan(b):
            part = t
            for k in range(3):
                part = _clip(part, v[k - 1], v[k]) if part else part
            total += s * u * sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(part, part[1:] + part[:1], strict=True)) / 2
    # the fans' own orientation
    turn = [sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(r, [*r[1:], r[0]], strict=True)) for r in (a, b)]
    return total if (turn[0] < 0) == (turn[1] < 0) else -total


@F.pandas_udf(T.DoubleType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_area(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def shared_area(parcels: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """a, b (a < b by parcel_id) and m2, the area in the rings' own unit that two parcels share, where it is positive.

    Only pairs whose boxes share an area reach the clipping.
    """
    strict = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    found = pairs(parcels, parcels, (F.col("a.parcel_id") < F.col("b.parcel_id")) & strict, size, keys)
    m2 = found.select(F.col("a.parcel_id").alias("a_id"), F.col("b.parcel_id").alias("b_id"), _common(g.opened(F.col("a.ring")), g.opened(F.col("b.ring"))).alias("m2"))
    return m2.where("m2 > 1e-9").selectExpr("a_id AS a", "b_id AS b", "m2")


def containments(parcels: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    return _containments(parcels, size, keys).select("outer", "inner")


def _containments(parcels: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    found = pairs(parcels, parcels, F.col("a.parcel_id") != F.col("b.parcel_id"), size, keys)
    return found.where(g.contains(F.col("a.ring"), F.col("b.ring"))).select(*_shared(keys), F.col("a.parcel_id").alias("outer"), F.col("b.parcel_id").alias("inner"))


def unsnapped(parcels: DataFrame, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """Corners of two parcels that nearly meet: a, b, their corners' places and the distance."""
    return _unsnapped(parcels, tolerance, keys).select("a", "b", "a_n", "b_n", "distance")


def _unsnapped(parcels: DataFrame, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    corner = parcels.select("parcel_id", *keys, F.posexplode(g.opened(F.col("ring"))).alias("n", "p"))
    c = corner.select("parcel_id", *keys, "n", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"))
    d = F.sqrt((F.col("a.x0") - F.col("b.x0")) ** 2 + (F.col("a.y0") - F.col("b.y0")) ** 2)
    near = pairs(c, c, (F.col("a.parcel_id") < F.col("b.parcel_id")) & (d > 0) & (d <= tolerance), 4 * tolerance, keys, reach=tolerance)
    return near.select(*_shared(keys), F.col("a.parcel_id").alias("a"), F.col("b.parcel_id").alias("b"), F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n"), F.round(d, 9).alias("distance"))


def report(parcels: DataFrame, size: float, tolerance: float, key: str) -> DataFrame:
    """Findings counted per sheet, and whether the sheet is clean; containment does not count against it."""
    n = parcels.groupBy(key).agg(F.count("*").alias("parcel_count"), F.sum(F.when(F.size(g.problems(F.col("ring"))) > 0, 1).otherwise(0)).alias("invalid"))
    o = _overlaps(parcels, size, [key]).groupBy(key).agg(F.sum(F.when(F.col("severity") == "overlap", 1).otherwise(0)).alias("overlaps"), F.sum(F.when(F.col("severity") == "sliver", 1).otherwise(0)).alias("slivers"))
    c = _containments(parcels, size, [key]).groupBy(key).agg(F.count("*").alias("containments"))
    u = _unsnapped(parcels, tolerance, [key]).groupBy(key).agg(F.count("*").alias("unsnapped"))
    j = n.join(o, key, "left").join(c, key, "left").join(u, key, "left").fillna(0)
    return j.withColumn("clean", (F.col("invalid") + F.col("overlaps") + F.col("slivers") + F.col("unsnapped")) == 0)


METRES_PER_DEGREE, SNAP_M = 110_540.0, 0.5


def suggested_tolerance(in_degrees: bool, metres: float = SNAP_M) -> float:
    """The snapping tolerance in a sheet's own unit."""
    return metres / METRES_PER_DEGREE if in_degrees else metres


def rings_of(parcels: DataFrame, prefer_geo: bool = True) -> DataFrame:
    """name and ring of parcels (khasra_number, parcel_id, geo_ring, pixel_ring): the mapped ring where there is one, else the drawn one."""
    ring = F.coalesce("geo_ring", "pixel_ring") if prefer_geo else F.col("pixel_ring")
    return parcels.select(F.coalesce(F.nullif("khasra_number", F.lit("")), F.col("parcel_id").cast("string")).alias("name"), ring.alias("ring")).where("ring IS NOT NULL AND size(ring) > 0")


def snap(parcels: DataFrame, tolerance: float, key: str) -> DataFrame:
    """Corners moved to the first corner within tolerance, per sheet, in order of parcel and corner.

    What a corner moves to depends on all before it, so a sheet is one task; sheets run in parallel.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["parcel_id", "n"])
        grid: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
        xs, ys = [], []
        for k, (x, y) in enumerate(zip(pdf["x"], pdf["y"], strict=True)):
            cx, cy = int(x // tolerance), int(y // tolerance)
            near = [a for i in (-1, 0, 1) for j in (-1, 0, 1) for a in grid.get((cx + i, cy + j), ()) if ((a[1] - x) ** 2 + (a[2] - y) ** 2) ** 0.5 <= tolerance]
            if near:
                _, x, y = min(near)
            else:
                grid.setdefault((cx, cy), []).append((k, x, y))
            xs.append(x)
            ys.append(y)
        return pdf.assign(sx=xs, sy=ys)

    corner = parcels.select(key, "parcel_id", F.posexplode(g.opened(F.col("ring"))).alias("n", "p")).select(key, "parcel_id", "n", "p.x", "p.y")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in corner.schema) + ", sx double, sy double"
    return corner.groupBy(key).applyInPandas(one, schema)
