"""Map projections and cell numbers, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the scale of UTM.
A, F_WGS84, K0 = 6378137.0, 1 / 298.257223563, 0.9996
E2 = F_WGS84 * (2 - F_WGS84)
EP2 = E2 / (1 - E2)
# The traversal order of S2 cells, by orientation.
POS_TO_IJ = ((0, 1, 3, 2), (0, 2, 3, 1), (3, 2, 0, 1), (3, 1, 0, 2))
POS_TO_ORIENTATION = (1, 0, 0, 3)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_forward(lon: Column, lat: Column) -> Column:
    """struct<zone, easting, northing> of a northern point; null south of the equator or outside the domain."""
    zone = utm_zone(lon)
    p, dl = F.radians(lat), F.radians(lon) - F.radians((zone - 1) * 6 - 177)
    s, c, t = F.sin(p), F.cos(p), F.tan(p)
    n = F.lit(A) / F.sqrt(1 - s * s * E2)
    t2, c2, a = t * t, c * c * EP2, dl * c
    m = A * ((1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * p - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * p) + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * p) - (35 * E2**3 / 3072) * F.sin(6 * p))
    east = K0 * n * (a + (1 - t2 + c2) * F.pow(a, F.lit(3)) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * EP2) * F.pow(a, F.lit(5)) / 120) + 500000.0
    north = K0 * (m + n * t * (a * a / 2 + (5 - t2 + 9 * c2 + 4 * c2 * c2) * F.pow(a, F.lit(4)) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * EP2) * F.pow(a, F.lit(6)) / 720))
    fits = (lat >= 0) & (lat <= 84) & lon.between(-180, 180)
    return F.when(fits, F.struct(zone.alias("zone"), east.alias("easting"), north.alias("northing")))


def s2_token(lat: Column, lon: Column, level: int = 6) -> Column:
    """The token of the S2 cell of a level that holds a point."""
    p, q = F.radians(lat), F.radians(lon)
    x, y, z = F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    axis = F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)
    face = axis + F.when(F.when(axis == 0, x).when(axis == 1, y).otherwise(z) < 0, 3).otherwise(0)
    d = F.when(axis == 0, x).when(axis == 1, y).otherwise(z)
    u = F.when(face == 0, y).when(face == 1, -x).when(face == 2, -x).when(face == 3, z).when(face == 4, z).otherwise(-y) / d
    v = F.when(face == 0, z).when(face == 1, z).when(face == 2, -y).when(face == 3, y).when(face == 4, -x).otherwise(-x) / d

    def cell(w: Column) -> Column:
        st = F.when(w >= 0, F.sqrt(1 + 3 * w) * 0.5).otherwise(1 - F.sqrt(1 - 3 * w) * 0.5)
        return F.greatest(F.lit(0), F.least(F.lit(2**30 - 1), F.floor(st * 2**30))).cast("long")

    i, j = cell(u), cell(v)
    table = F.array(*[F.lit(POS_TO_IJ[o].index(ij)) for o in range(4) for ij in range(4)])
    turn = F.array(*[F.lit(o) for o in POS_TO_ORIENTATION])

    def step(acc: Column, k: Column) -> Column:
        bits = F.call_function("shiftright", i, k).bitwiseAND(F.lit(1)) * 2 + F.call_function("shiftright", j, k).bitwiseAND(F.lit(1))
        quad = F.get(table, (acc["o"] * 4 + bits).cast("int"))
        return F.struct((acc["pos"] * 4 + quad).alias("pos"), acc["o"].bitwiseXOR(F.get(turn, quad)).cast("int").alias("o"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), face.bitwiseAND(F.lit(1)).cast("int").alias("o"))
    walked = F.aggregate(F.sequence(F.lit(29), F.lit(30 - level), F.lit(-1)), start, step)["pos"]
    # face, position and a closing bit fill the leading bits; the rest of the number is zero
    head = (face.cast("long") * 2 ** (2 * level) + walked) * 2 + 1
    bits = 3 + 2 * level + 1
    pad = -bits % 4
    digits = (bits + pad) // 4
    return F.regexp_replace(F.lower(F.lpad(F.hex(head * 2**pad), digits, "0")), "0+$", "")


def haversine_m(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), F.lit(2)) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), F.lit(2))
    return F.asin(F.sqrt(a)) * 2 * 6371008.8


def box_around(lat: Column, lon: Column, km: float) -> Column:
    """The box of degrees that holds everything within some kilometres of a point."""
    dlat = km / 110.574
    dlon = F.lit(km) / (F.cos(F.radians(lat)) * 111.320)
    return F.struct((lon - dlon).alias("x0"), (lat - dlat).alias("y0"), (lon + dlon).alias("x1"), (lat + dlat).alias("y1"))


def geodesic_scale(lat: float) -> float:
    """Square metres of a square degree at a latitude, for tests."""
    return math.cos(math.radians(lat)) * 111_320.0 * 110_540.0
