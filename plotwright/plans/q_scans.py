"""Queries over scan measures and recovered values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recovery, scans
from .bindings import base, ctes, frame
from .registry import query


@query("SELECT p_partkey, p_size * 10 >= 200 AND (p_partkey % 100)::DOUBLE / 100 >= 0.55 AND 1 - (p_partkey % 100)::DOUBLE / 100 <= 0.40 AS is_map FROM part")
def filter_parcel_map_like(spark, sf):
    return base(spark, sf, "part").select("p_partkey", scans.parcel_map_like(F.col("p_size") * 10, (F.col("p_partkey") % 100).cast("double") / 100).alias("is_map"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice BETWEEN 4000 AND 60000 AND abs(l_quantity / 25 - 1) <= 0.45 AS seal, l_discount BETWEEN 0.003 AND 0.35 AS signature FROM lineitem")
def filter_seals_and_signatures(spark, sf):
    return base(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scans.is_seal(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(25)).alias("seal"), scans.is_signature(F.col("l_discount")).alias("signature"))


@query("SELECT doc_id, contains(upper(text), 'NON JUDICIAL') OR contains(upper(text), 'NON-JUDICIAL') AS stamped, contains(upper(concat(text, ' india Non-Judicial')), 'NON-JUDICIAL') AS control FROM documents")
def str_stamp_paper(spark, sf):
    return base(spark, sf, "documents").select("doc_id", scans.stamp_paper(F.col("text")).alias("stamped"), scans.stamp_paper(F.concat("text", F.lit(" india Non-Judicial"))).alias("control"))


@query(ctes("parcels") + "SELECT parcel_id, CASE WHEN parcel_id % 7 = 0 THEN 'projected' WHEN x0 * 10 < -180 OR x1 * 10 > 180 OR y0 < -90 OR y1 > 90 THEN 'out of range' END AS why FROM parcels")
def filter_lonlat_fits(spark, sf):
    c = F.col
    return frame(spark, sf, "parcels").select("parcel_id", scans.lonlat_fits(c("x0") * 10, c("y0"), c("x1") * 10, c("y1"), c("parcel_id") % 7 == 0).alias("why"))


LANGS = "CASE l_linenumber WHEN 1 THEN 'eng' WHEN 2 THEN 'hin' WHEN 3 THEN 'guj' ELSE concat('x', l_linenumber) END"


@query(f"""WITH t AS (SELECT l_orderkey AS image, {LANGS} AS lang, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, lang) AS rn, max(score) FILTER (lang = 'eng') OVER (PARTITION BY image) AS eng FROM t)
SELECT image, CASE WHEN lang <> 'eng' AND eng IS NOT NULL AND score - eng < 10 THEN 'eng' ELSE lang END AS lang, round(score, 2) AS best_score, coalesce(lang <> 'eng' AND eng IS NOT NULL AND score - eng < 10, false) AS gated FROM b WHERE rn = 1""")
def topk_choose_language(spark, sf):
    lang = F.expr(LANGS)
    t = base(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image"), lang.alias("lang")).agg(F.max("l_quantity").alias("score"))
    return scans.choose_language(t, "image")


@query("""WITH s AS (SELECT p_brand AS sheet, p_partkey, (p_size * p_size * 10)::DOUBLE AS area FROM part WHERE p_size * p_size * 10 BETWEEN 2000 AND 0.9 * 25000), m AS (SELECT sheet, median(area) AS med FROM s GROUP BY sheet)
SELECT s.sheet, p_partkey, area FROM s JOIN m USING (sheet) WHERE area <= med * 4""")
def filter_plausible_regions(spark, sf):
    r = base(spark, sf, "part").select(F.col("p_brand").alias("sheet"), "p_partkey", (F.col("p_size") * F.col("p_size") * 10).cast("double").alias("area"))
    return scans.plausible_regions(r, "sheet", F.lit(25000.0))


@query()
def topo_drop_nested(spark, sf):
    return scans.drop_nested(frame(spark, sf, "parcels").withColumnRenamed("parcel_id", "mask_id"), "map_id")


@query(ctes("parcels") + "SELECT map_id, khasra_number AS subject, n AS labels FROM (SELECT map_id, khasra_number, count(*) OVER (PARTITION BY map_id) AS n, row_number() OVER (PARTITION BY map_id ORDER BY (x0 - 25.0) * (x0 - 25.0) + (y0 - 5.0) * (y0 - 5.0), khasra_number) AS rn FROM parcels) WHERE rn = 1")
def topk_subject_label(spark, sf):
    p = frame(spark, sf, "parcels").select("map_id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("khasra_number").alias("text"), F.lit(25.0).alias("cx"), F.lit(5.0).alias("cy"))
    return scans.subject_label(p, "map_id")


def _lines(spark, sf):
    """Two readings of lines: the second has the true digits, and lies a little lower."""
    o = base(spark, sf, "orders").select((F.col("o_orderkey") % 200).alias("page"), F.col("o_orderkey").alias("line_no"), F.col("o_custkey").alias("n"))
    y = (F.col("line_no") / 200).cast("int") * 20.0
    box = [F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(100.0).alias("x1"), (y + 10).alias("y1")]
    first = o.select("page", "line_no", F.concat(F.lit("khata "), (F.col("n") + 1).cast("string"), F.lit(" of 7")).alias("text"), *box)
    second = o.where("line_no % 3 > 0").select("page", "line_no", F.concat(F.lit("kh "), F.col("n").cast("string"), F.lit("/ 7")).alias("text"), F.lit(5.0).alias("x0"), (y + 2).alias("y0"), F.lit(98.0).alias("x1"), (y + 12).alias("y1"))
    return first, second


@query("SELECT o_orderkey % 200 AS page, o_orderkey AS line_no, concat('khata ', CASE WHEN o_orderkey % 3 > 0 THEN o_custkey ELSE o_custkey + 1 END, ' of 7') AS text, o_orderkey % 3 > 0 AS changed FROM orders")
def join_repair_digits(spark, sf):
    return scans.repair_digits(*_lines(spark, sf))


@query()
def read_visual_rows(spark, sf):
    c = F.col
    words = base(spark, sf, "lineitem").select(c("l_orderkey").alias("page"), (c("l_partkey") % 500).cast("double").alias("x0"), (c("l_linenumber") * 12.0 + c("l_suppkey") % 4).alias("y0"), (c("l_partkey") % 500 + 30.0).alias("x1"), (c("l_linenumber") * 12.0 + c("l_suppkey") % 4 + 10).alias("y1"), F.concat(F.lit("w"), c("l_partkey").cast("string")).alias("text"))
    return scans.visual_rows(words, "page")


@query(r"SELECT item_id, CASE WHEN length(text) <= 20 THEN text ELSE array_to_string(ws[1:greatest(1, coalesce(list_max(list_filter(range(1, len(ws) + 1), lambda k: length(array_to_string(ws[1:k], ' ')) <= 20)), 1))], ' ') END AS kept FROM (SELECT item_id, text, regexp_split_to_array(trim(text), '\s+') AS ws FROM benchmark)")
def str_trim_overrun(spark, sf):
    cut = scans.trim_overrun(F.col("text"), F.lit(200.0), F.lit(10.0))
    return base(spark, sf, "benchmark").select("item_id", cut.alias("kept"))


@query(ctes("points") + "SELECT point_id, (floor(x / 7) * 100 + floor(y / 7))::BIGINT AS tile_id FROM points WHERE x < 49 AND y < 35")
def join_covering_tile(spark, sf):
    tiles = spark.range(7).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    tiles = tiles.select((F.col("i") * 100 + F.col("j")).alias("tile_id"), (F.col("i") * 7.0).alias("x0"), (F.col("j") * 7.0).alias("y0"), (F.col("i") * 7.0 + 7).alias("x1"), (F.col("j") * 7.0 + 7).alias("y1"))
    return scans.covering_tile(frame(spark, sf, "points"), tiles, 5.0)


@query(ctes("rec_values", "admin") + """, m AS (SELECT DISTINCT lower(district) AS dk, state AS m_state FROM admin)
SELECT id, CASE WHEN coalesce(state, '') = '' AND m_state IS NOT NULL THEN m_state ELSE state END AS state, CASE WHEN coalesce(state, '') = '' AND m_state IS NOT NULL THEN least(0.80, confidence) END AS derived_confidence FROM rec_values LEFT JOIN m ON dk = lower(coalesce(district, ''))""")
def join_derive_state(spark, sf):
    r = frame(spark, sf, "rec_values").withColumn("district_confidence", F.col("confidence"))
    return recovery.derive_state(r, frame(spark, sf, "admin"))


def _prose(spark, sf):
    r = frame(spark, sf, "rec_values").where("district IS NOT NULL")
    letters = F.translate("district", "0123456789_", "ABCDEFGHIJ ")
    return r.select("id", F.concat(F.lit("the land in Village Alpha Beta of District "), letters, F.lit(" is sold")).alias("text"))


def _names(spark, sf):
    d = base(spark, sf, "nation").select(F.lit("district").alias("kind"), F.translate("n_name", "0123456789_", "ABCDEFGHIJ ").alias("name"))
    return d


@query(ctes("rec_values") + """SELECT id, 'village' AS kind, 'Alpha Beta' AS value, 0.50::DOUBLE AS confidence FROM rec_values WHERE district IS NOT NULL
UNION ALL SELECT id, 'district', translate(n_name, '0123456789_', 'ABCDEFGHIJ '), 0.62 FROM rec_values JOIN nation ON n_name = district""")
def place_from_prose(spark, sf):
    return recovery.places_in_prose(_prose(spark, sf), "id", "text", _names(spark, sf))


@query(ctes("rec_values") + """SELECT id, 'village' AS field_key, CASE WHEN coalesce(village, '') = '' THEN 'Alpha Beta' ELSE village END AS value, CASE WHEN coalesce(village, '') = '' THEN 0.5 ELSE confidence END AS confidence, coalesce(village, '') = '' AS recovered FROM rec_values WHERE district IS NOT NULL""")
def join_recover_from_prose(spark, sf):
    v = frame(spark, sf, "rec_values").where("district IS NOT NULL").select("id", F.lit("village").alias("field_key"), F.col("village").alias("value"), "confidence")
    return recovery.recover(v, recovery.places_in_prose(_prose(spark, sf), "id", "text", _names(spark, sf)).where("kind = 'village'"))


@query(ctes("rec_values") + "SELECT id, 'owner_name' AS field_key, upper(owner_name) AS suggestion, 0.70::DOUBLE AS confidence FROM rec_values WHERE owner_name IS NOT NULL AND confidence < 0.80 AND id % 2 = 0")
def join_adopt_suggestions(spark, sf):
    v = frame(spark, sf, "rec_values").where("owner_name IS NOT NULL")
    fields = v.select("id", F.lit("owner_name").alias("field_key"), F.col("owner_name").alias("value"), "confidence")
    said = v.select("id", F.lit("owner_name").alias("field_key"), F.upper("owner_name").alias("suggestion"))
    texts = v.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("sold by "), F.lower("owner_name"))).otherwise("nothing here, x").alias("text"))
    return recovery.adopt_suggestions(fields, said, texts)
