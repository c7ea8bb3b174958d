"""Column functions against known values."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from plotwright.functions import geodesy, similarity
from plotwright.functions import geometry as g
from plotwright.functions import text as t
from plotwright.functions.parse import parse_area, parse_date
from plotwright.operators import gazetteer, vertical
from plotwright.sources import readers

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
EAST = [(10, 0), (20, 0), (20, 10), (10, 10)]
OVERLAP = [(5, 5), (15, 5), (15, 15), (5, 15)]
ENVELOPE = [(-5, -5), (25, -5), (25, 25), (-5, 25)]
BOWTIE = [(0, 0), (10, 10), (10, 0), (0, 10)]
FAR = [(100, 100), (110, 100), (110, 110), (100, 110)]


def each(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("raw", "iso"),
    [("12/03/2019", "2019-03-12"), ("2019-03-12", "2019-03-12"), ("12 मार्च 2019", "2019-03-12"), ("12 Mar 2019", "2019-03-12"), ("1-2-29", "2029-02-01"), ("1-2-31", "1931-02-01"), ("3/25/2019", "2019-03-25"), ("13/25/2019", None), ("१२/०३/२०१९", "2019-03-12"), ("", None), (None, None), ("31/02/2019", "2019-02-31")],
)
def test_dates(spark, raw, iso):
    assert each(spark, [raw], parse_date) == [iso]


@pytest.mark.parametrize(
    ("raw", "sqm", "regional", "missing"),
    [("0.4820 hectare", 4820.0, False, False), ("2 बीघा 10 बिस्वा", 6322.98, True, False), ("57 SQ.YDS.", 47.659, False, False), ("MEAS. 57 ong sq.yds", 47.659, False, False), ("1,250 sq.m", 1250.0, False, False), ("12", None, False, True), ("17.3 x 3 sq.yds", 2.508, False, False)],
)
def test_areas(spark, raw, sqm, regional, missing):
    (a,) = each(spark, [raw], parse_area)
    assert (a.sqm, a.regional_unit, a.unit_missing) == (sqm, regional, missing)


def test_no_area(spark):
    assert each(spark, ["blah", "", None], parse_area) == [None, None, None]


def test_text(spark):
    assert each(spark, ["२३७ / ४;  x"], t.normalise) == ["237 / 4: x"]
    assert each(spark, ["Khasra", "खसरा", "खसरा Khasra No", "123", "ગુજરાત"], t.detect_script) == ["latin", "devanagari", "latin", "unknown", "gujarati"]
    assert each(spark, ["142/2B", "l42", "O0S", "- 12/", "14a"], t.clean_number) == ["142/2B", "142", "00S", "12", "14"]
    assert each(spark, ["Aurangabad", "Barkhedi", "Poonaa"], t.fold_roman) == ["orangabad", "barkhedi", "puna"]
    assert each(spark, ["Jallaa"], lambda c: t.fold_roman(c, True)) == ["jal"]
    rows = spark.createDataFrame([("night", "nacht"), ("a", "a"), ("", "x"), ("ab", "cd")], "a string, b string")
    assert [r[0] for r in rows.select(t.dice(F.col("a"), F.col("b"))).collect()] == [0.25, 1.0, 0.0, 0.0]


def test_similarity():
    assert similarity.indel("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert similarity.indel("", "") == 100.0 and similarity.indel(None, "x") is None
    assert similarity.lcs_length("AGGTAB", "GXTXAYB") == 4
    assert similarity.aligned_confusions("4474", "4471") == ["41"]
    assert similarity.romanise("नरहरपुर") == "naraharapura" and similarity.romanise("कानपुर") == "kaanapura"
    assert similarity.romanise("ड़") == "da"


def test_phonetic_bridge(spark):
    deva, latin = each(spark, ["कानपुर", "Kanpur"], gazetteer.phonetic_key)
    assert similarity.indel(deva, latin) >= 84
    assert unicodedata.normalize("NFC", "é") == each(spark, ["é"], lambda c: similarity.nfc(c))[0]


def rings(spark, *rs):
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in r]) for k, r in enumerate(rs)]
    return spark.createDataFrame(rows, f"k int, ring {g.RING}")


def test_rings(spark):
    df = rings(spark, SQUARE, SQUARE[::-1], SQUARE + SQUARE[:1], BOWTIE, SQUARE[:2])
    out = df.select("k", g.signed_area(F.col("ring")).alias("a"), g.problems(F.col("ring")).alias("p")).orderBy("k").collect()
    assert [r.a for r in out] == [100.0, -100.0, 100.0, 0.0, 0.0]
    assert [list(r.p) for r in out] == [[], [], [], ["zero area", "self-intersection"], ["fewer than 3 distinct vertices"]]


@pytest.mark.parametrize(("a", "b", "kind"), [(SQUARE, EAST, None), (SQUARE, OVERLAP, "overlap"), (SQUARE, ENVELOPE, None), (SQUARE, FAR, None), (SQUARE, [(9.9, 5), (20, 4), (20, 6)], "overlap")])
def test_overlap(spark, a, b, kind):
    df = rings(spark, a, b)
    j = df.where("k = 0").select(F.col("ring").alias("r")).join(df.where("k = 1").select(F.col("ring").alias("s")))
    assert j.select(g.overlap_kind(F.col("r"), F.col("s"))).first()[0] == kind
    assert j.select(g.contains(F.col("s"), F.col("r"))).first()[0] == (b is ENVELOPE)


def test_side(spark):
    df = rings(spark, SQUARE)
    for x, y, side in ((5, 5, "inside"), (0, 5, "boundary"), (10, 10, "boundary"), (11, 5, "outside"), (5, -1, "outside")):
        assert df.select(g.side_of(g.point(F.lit(float(x)), F.lit(float(y))), F.col("ring"))).first()[0] == side


def test_wkt(spark):
    df = rings(spark, SQUARE)
    assert df.select(g.to_wkt(F.col("ring"))).first()[0] == "POLYGON((0.0 0.0,10.0 0.0,10.0 10.0,0.0 10.0,0.0 0.0))"
    assert each(spark, ["POLYGON ((1 2, 3 4, 5 0, 1 2))", "POINT (1 2)", None], g.from_wkt)[1:] == [None, None]


@pytest.mark.parametrize(("lat", "lon", "token"), [(25.75, 82.68, "3991"), (26.85, 80.95, "399b"), (18.59, 73.74, "3bc3")])
def test_s2(spark, lat, lon, token):
    assert spark.range(1).select(geodesy.s2_token(F.lit(lat), F.lit(lon))).first()[0] == token


def test_utm(spark):
    u = spark.range(1).select(geodesy.utm_forward(F.lit(81.0), F.lit(0.0)).alias("u")).first().u
    assert u.zone == 44 and u.easting == pytest.approx(500000, abs=1e-6) and u.northing == pytest.approx(0, abs=1e-6)
    east = spark.range(1).select(geodesy.utm_forward(F.lit(84.0), F.lit(26.0)).alias("u")).first().u
    # 3 degrees from the central meridian
    assert east.zone == 45 or east.easting == pytest.approx(500000 + 3 * 111320 * math.cos(math.radians(26)), rel=1e-3)
    assert spark.range(1).select(geodesy.utm_forward(F.lit(81.0), F.lit(-1.0)).alias("u")).first().u is None


def test_check_character_catches_errors(spark):
    body = "UP091223700412-F03-012"
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    variants = [body] + [body[:i] + c + body[i + 1 :] for i in range(len(body)) if body[i] != "-" for c in letters if c != body[i]]
    swaps = [body[:i] + body[i + 1] + body[i] + body[i + 2 :] for i in range(len(body) - 1) if body[i] != body[i + 1] and "-" not in body[i : i + 2]]
    first, *rest = each(spark, variants + swaps, vertical.check_character)
    assert first == "D" and first not in rest and len(rest) == 35 * 20 + len(swaps)


def test_identifiers(spark):
    ids = each(spark, ["UP091223700412-F03-012", "up091223700412-02-B01-001", "UP091223700412-F03-012-D", "UP091223700412-F03-012-E", "x"], vertical.parse_id)
    assert (ids[0].parcel_ulpin, ids[0].level_code, ids[0].unit, ids[0].building) == ("UP091223700412", "F03", 12, None)
    assert ids[1].building == 2 and ids[1].level_kind == "basement" and ids[2].check_character == "D"
    assert ids[3] is None and ids[4] is None


def test_levels(spark):
    codes = ["F02", "G00", "B01", "A01", "S01", "B02", "F01"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r.c for r in df.orderBy(vertical.sort_key(F.col("c"))).collect()] == "S01 B02 B01 G00 F01 F02 A01".split()
    assert [tuple(x) for x in each(spark, ["G00", "F02", "B01", "A01", "S01"], vertical.elevation)] == [(0.0, 3.0), (6.0, 9.0), (-3.0, 0.0), (100.0, 103.0), (-103.0, -100.0)]
    with pytest.raises(ValueError, match="storey"):
        vertical.elevation(F.lit("F01"), -1)


def test_world_file(spark):
    assert each(spark, ["0.5\n0\n0\n-0.5\n80.1\n26.2\n", "1 2 3", "a b c d e f"], readers.world_file)[1:] == [None, None]
