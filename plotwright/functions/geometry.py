"""Rings as arrays of points, as column expressions. A ring may repeat its first point at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let

RING = "array<struct<x:double,y:double>>"
# Metres in a degree.
M_PER_DEG_LAT, M_PER_DEG_LON = 110_540.0, 111_320.0
TOLERANCE = 1e-9


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The ring of a box, counter-clockwise."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def opened(ring: Column) -> Column:
    """The ring without a repeated last point."""
    n = F.size(ring)
    return F.when((n > 1) & (F.get(ring, 0) == F.get(ring, n - 1)), F.slice(ring, 1, F.greatest(n - 1, F.lit(1)))).otherwise(ring)


def closed(ring: Column) -> Column:
    return let(ring, lambda r: F.concat(opened(r), F.slice(r, 1, 1)))


def edges(ring: Column) -> Column:
    """array<struct<a, b>> of the sides of the ring."""
    return let(ring, lambda r: let(opened(r), _sides))


def _sides(r: Column) -> Column:
    """`edges` of a ring that is open."""
    return F.arrays_zip(r.alias("a"), F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)).alias("b"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counter-clockwise; 0 with fewer than three points."""

    def of(r: Column) -> Column:
        parts = F.transform(_sides(r), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
        return F.when(F.size(r) < 3, 0.0).otherwise(_sum(parts) / 2)

    return let(ring, lambda r: let(opened(r), of))


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def area_m2(ring: Column) -> Column:
    """Area in square metres of a ring in degrees, on a plane scaled at its mean latitude."""
    r = opened(ring)
    lat = _sum(F.transform(r, lambda p: p["y"])) / F.size(r)
    scale = F.cos(F.radians(lat)) * M_PER_DEG_LON * M_PER_DEG_LAT
    return area(ring) * scale


def centroid(ring: Column) -> Column:
    """The mean of the corners; null without any."""
    r = opened(ring)
    return F.when(F.size(r) > 0, point(_sum(F.transform(r, lambda p: p["x"])) / F.size(r), _sum(F.transform(r, lambda p: p["y"])) / F.size(r)))


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _cross(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def on_side(a: Column, b: Column, p: Column, tol: float = TOLERANCE) -> Column:
    reach = F.greatest(F.lit(1.0), F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2))
    within = p["x"].between(F.least(a["x"], b["x"]) - tol, F.greatest(a["x"], b["x"]) + tol) & p["y"].between(F.least(a["y"], b["y"]) - tol, F.greatest(a["y"], b["y"]) + tol)
    return (F.abs(_cross(a, b, p)) <= reach * tol) & within


def _side(p: Column, sides: Column) -> Column:
    """inside, boundary or outside of a ring given by its sides."""

    def passed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < a["x"] + F.try_divide(p["y"] - a["y"], b["y"] - a["y"]) * (b["x"] - a["x"]))

    touching = F.exists(sides, lambda e: on_side(e["a"], e["b"], p))
    return F.when(F.size(sides) < 3, "outside").when(touching, "boundary").when(F.size(F.filter(sides, passed)) % 2 == 1, "inside").otherwise("outside")


def side_of(p: Column, ring: Column) -> Column:
    """inside, boundary or outside, by a ray along x; outside with fewer than three points."""
    return let(edges(ring), lambda sides: _side(p, sides))


def corner_sides(r: Column, s: Column) -> Column:
    """For each corner of r where it lies in s; the sides of s are made once."""
    return let(edges(s), lambda sides: F.transform(opened(r), lambda p: _side(p, sides)))


def sides_cross(a: Column, b: Column, c: Column, d: Column, tol: float = 1e-12) -> Column:
    """Whether two sides cross inside both."""

    def apart(x: Column, y: Column) -> Column:
        return ((x > tol) & (y < -tol)) | ((x < -tol) & (y > tol))

    return apart(_cross(c, d, a), _cross(c, d, b)) & apart(_cross(a, b, c), _cross(a, b, d))


def rings_cross(r: Column, s: Column) -> Column:
    return let(edges(s), lambda sides: F.exists(edges(r), lambda e: F.exists(sides, lambda f: sides_cross(e["a"], e["b"], f["a"], f["b"]))))


def _holds(outer_area: Column, inner_area: Column, where: Column) -> Column:
    return (outer_area > inner_area) & ~F.array_contains(where, "outside") & F.array_contains(where, "inside")


def contains(outer: Column, inner: Column) -> Column:
    """Whether inner lies in outer: a smaller ring, no corner outside, one inside."""
    return let(corner_sides(inner, outer), lambda where: _holds(area(outer), area(inner), where))


def overlap_kind(r: Column, s: Column) -> Column:
    """overlap, sliver, or null: shared interior that is no containment; a sliver has no crossing and one corner inside at most."""
    seen = F.struct(corner_sides(r, s).alias("r"), corner_sides(s, r).alias("s"), rings_cross(r, s).alias("crossing"), area(r).alias("ra"), area(s).alias("sa"))

    def kind(k: Column) -> Column:
        deep = F.size(F.filter(k["r"], lambda x: x == "inside")) + F.size(F.filter(k["s"], lambda x: x == "inside"))
        held = _holds(k["sa"], k["ra"], k["r"]) | _holds(k["ra"], k["sa"], k["s"])
        return F.when(held, None).when(k["crossing"] | (deep > 1), "overlap").when(deep > 0, "sliver")

    return let(seen, kind)


def problems(ring: Column) -> Column:
    """What is wrong with a ring, as text; empty if it is sound."""
    r = opened(ring)
    n = F.size(r)
    numbered = F.transform(edges(ring), lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i")))
    twice = F.size(F.array_distinct(r)) < n
    crossed = F.exists(numbered, lambda e: F.exists(numbered, lambda f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1)) & sides_cross(e["a"], e["b"], f["a"], f["b"])))
    some = F.array(F.when(area(ring) <= 0, "zero area"), F.when(twice, "repeated vertex"), F.when(crossed, "self-intersection"))
    return F.when(n < 3, F.array(F.lit("fewer than 3 distinct vertices"))).otherwise(F.filter(some, lambda x: x.isNotNull()))


def to_wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(closed(ring), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit("))"))


def from_wkt(text: Column) -> Column:
    """The outer ring of a WKT polygon, opened; null if it has fewer than three points."""
    inner = F.regexp_extract(text, r"(?is)POLYGON\s*\(\((.*?)\)", 1)
    pairs = F.filter(F.transform(F.split(inner, ","), lambda s: F.split(F.trim(s), r"\s+")), lambda a: F.size(a) >= 2)
    points = F.transform(pairs, lambda a: point(F.get(a, 0).try_cast("double"), F.get(a, 1).try_cast("double")))
    return let(points, lambda p: let(opened(p), lambda ring: F.when(F.size(ring) >= 3, ring)))


def affine(ring: Column, c: dict[str, float | Column]) -> Column:
    """A ring under x' = a x + b y + c, y' = d x + e y + f."""
    k = {n: v if isinstance(v, Column) else F.lit(float(v)) for n, v in c.items()}
    return F.transform(ring, lambda p: point(k["a"] * p["x"] + k["b"] * p["y"] + k["c"], k["d"] * p["x"] + k["e"] * p["y"] + k["f"]))


def rotated(c: dict[str, Column], epsilon: float = 1e-6) -> Column:
    """Whether an affine has rotation or skew, relative to its pixel size."""
    scale = F.greatest(F.abs(c["a"]), F.abs(c["e"]))
    tilt = F.greatest(F.abs(c["b"]), F.abs(c["d"]))
    return F.when(scale == 0, tilt > 0).otherwise(tilt > scale * epsilon)
