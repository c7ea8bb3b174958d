"""The land-record tables as fixed arithmetic over the star-schema tables.

Each binding is one SQL text that both engines read: `{name}` stands for a base table and
`[[a..b]]` for a generator of the integers a to b. Spark reads it through `frame`, the checking SQL
through `ctes`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The day that rules take as today.
TODAY = "1998-06-30"

BINDINGS = {
    # one scanned record per order
    "rec_documents": """
SELECT o_orderkey AS id, concat('record-', o_orderkey, '.pdf') AS filename,
  CASE o_orderstatus WHEN 'O' THEN 'needs_review' WHEN 'F' THEN 'approved' ELSE 'blocked' END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 10 END AS trust_score,
  CAST(o_custkey % 101 AS DOUBLE) AS legibility, CAST(o_orderkey % 97 AS DOUBLE) / 100 AS mean_ocr_conf,
  1 + o_orderkey % 4 AS page_count, o_orderkey % 5000 AS processing_ms, o_orderdate AS uploaded_at,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS ocr_engine, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END AS uploaded_by,
  CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS error_count, o_orderkey % 3 AS warning_count,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat(o_custkey % 500, '|', o_orderkey % 40, '|', o_orderpriority) END AS signature
FROM {orders}""",
    "rec_users": """
SELECT c_custkey AS id, concat('user', c_custkey) AS username, c_name AS full_name,
  CASE c_custkey % 4 WHEN 0 THEN 'operator' WHEN 1 THEN 'verifier' WHEN 2 THEN 'admin' ELSE 'auditor' END AS role, c_mktsegment AS office
FROM {customer}""",
    # seven extracted fields per record
    "rec_fields": """
SELECT document_id, k, CASE k WHEN 0 THEN 'khasra_number' WHEN 1 THEN 'owner_name' WHEN 2 THEN 'village' WHEN 3 THEN 'tehsil' WHEN 4 THEN 'district' WHEN 5 THEN 'area' ELSE 'land_classification' END AS field_key,
  CASE WHEN (document_id * 3 + k * 5) % 17 = 0 THEN NULL ELSE CASE k WHEN 0 THEN khasra WHEN 1 THEN owner WHEN 2 THEN village WHEN 3 THEN tehsil WHEN 4 THEN district WHEN 5 THEN area ELSE land END END AS value,
  CASE WHEN (document_id * 3 + k * 5) % 17 = 0 THEN 'missing' ELSE CASE (document_id + k) % 5 WHEN 0 THEN 'corrected' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'needs_review' ELSE 'extracted' END END AS status,
  CASE WHEN (document_id + 3 * k) % 23 = 0 THEN NULL ELSE CAST((document_id * 13 + k * 29) % 1000 AS DOUBLE) / 1000 END AS ai_confidence,
  CASE WHEN (document_id + k) % 5 = 0 THEN 1 + document_id % 600 ELSE NULL END AS corrected_by
FROM (SELECT o_orderkey AS document_id, concat(o_custkey % 500, '/', 1 + o_orderkey % 9) AS khasra, c_name AS owner, concat('village ', o_custkey % 60) AS village, c_mktsegment AS tehsil,
    n_name AS district, concat(1 + o_orderkey % 90, CASE o_orderkey % 5 WHEN 0 THEN ' hectare' WHEN 1 THEN ' acre' WHEN 2 THEN ' sq.m' WHEN 3 THEN ' bigha' ELSE '' END) AS area,
    CASE o_orderkey % 4 WHEN 0 THEN 'residential' WHEN 1 THEN 'forest' WHEN 2 THEN 'barren' ELSE 'unlisted' END AS land, [[0..6]] AS k
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey) x""",
    # one flat record per order, as the rules read it
    "rec_values": """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN '0/0' WHEN o_orderkey % 29 = 0 THEN 'x/12' ELSE concat(o_custkey % 500, '/', 1 + o_orderkey % 9) END AS khasra_number,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('', o_custkey % 3000) END AS khata_number,
  CASE WHEN o_orderkey % 27 = 0 THEN concat('s', o_orderkey % 50) END AS survey_number,
  CASE WHEN o_orderkey % 8 = 0 THEN concat('UP', lpad(concat('', o_orderkey), 12, '0')) WHEN o_orderkey % 8 = 1 THEN 'bad' END AS ulpin,
  CASE o_orderkey % 14 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN 'Unknown' ELSE c_name END AS owner_name,
  CASE o_orderkey % 6 WHEN 0 THEN concat(' ', c_name, '  ') WHEN 1 THEN 'nil' ELSE concat('Father of ', o_custkey) END AS father_name,
  CASE o_orderkey % 9 WHEN 0 THEN '1/2' WHEN 1 THEN '7/5' WHEN 2 THEN '1/0' WHEN 3 THEN '150%' WHEN 4 THEN '0%' WHEN 5 THEN '33.5 %' WHEN 6 THEN 'half' END AS share,
  CASE o_orderkey % 12 WHEN 0 THEN '0.4820 hectare' WHEN 1 THEN '2 bigha 10 biswa' WHEN 2 THEN '57 SQ.YDS.' WHEN 3 THEN 'blah' WHEN 4 THEN '12' WHEN 5 THEN '3 sqm' WHEN 6 THEN '0.3 sq.m' WHEN 7 THEN '500 hectare' WHEN 8 THEN '5000 ha' WHEN 9 THEN '0 acre' WHEN 10 THEN NULL ELSE '1,250 sq.m' END AS area,
  CASE o_orderkey % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'forest' WHEN 2 THEN 'meadow' WHEN 3 THEN 'N/A' END AS land_classification,
  CASE o_orderkey % 15 WHEN 0 THEN NULL ELSE concat('village ', o_custkey % 60) END AS village,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'elsewhere' ELSE c_mktsegment END AS tehsil,
  CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN concat(n_name, 'X') ELSE n_name END AS district,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN r_name WHEN 2 THEN lower(r_name) ELSE 'ASIA' END AS state,
  CASE o_orderkey % 5 WHEN 0 THEN concat('M-', o_orderkey % 100) WHEN 1 THEN 'M/1/' END AS mutation_number,
  CASE o_orderkey % 6 WHEN 0 THEN '1999-02-01' WHEN 1 THEN '1840-01-05' WHEN 2 THEN '12/03/1997' WHEN 3 THEN '1996-05-04' WHEN 4 THEN '1997-02-31' END AS mutation_date,
  CASE o_orderkey % 4 WHEN 0 THEN concat(o_orderkey % 1000, '/97') WHEN 1 THEN '-' END AS registration_number,
  CASE o_orderkey % 3 WHEN 0 THEN '1997-11-30' WHEN 1 THEN '1995-01-01' END AS registration_date,
  CAST((o_orderkey * 17) % 1000 AS DOUBLE) / 1000 AS confidence
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "rec_corrections": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS document_id, CASE l_linenumber % 3 WHEN 0 THEN 'khata_number' WHEN 1 THEN 'village' ELSE 'district' END AS field_key,
  CASE l_linenumber % 3 WHEN 0 THEN concat('1', l_partkey % 7, '4') ELSE concat('Name-', l_partkey % 6) END AS ai_value,
  CASE l_linenumber % 3 WHEN 0 THEN concat('1', l_partkey % 7, '1') ELSE concat('Name ', CASE WHEN l_suppkey % 10 < 8 THEN l_partkey % 6 ELSE 9 END) END AS human_value
FROM {lineitem} WHERE l_returnflag = 'R'""",
    "rec_audit": """
SELECT event_id AS id, ts AS at, user_id, event_type AS action, event_id % 40 AS document_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS detail
FROM {events}""",
    # a box-shaped parcel per part, on sheets named by the brand
    "parcels": """
SELECT p_partkey AS parcel_id, p_brand AS map_id, concat(p_partkey % 300, '/', 1 + p_size % 5) AS khasra_number, p_partkey % 97 AS document_id,
  CAST(p_partkey % 50 AS DOUBLE) AS x0, floor(CAST(p_partkey AS DOUBLE) / 50) AS y0,
  CAST(p_partkey % 50 AS DOUBLE) + 0.6 + CAST(p_size AS DOUBLE) / 50 AS x1, floor(CAST(p_partkey AS DOUBLE) / 50) + 0.6 + CAST(p_size AS DOUBLE) / 50 AS y1
FROM {part}""",
    # declared volumes: levels and units on parcels named by the brand
    "volumes": """
SELECT p_partkey AS rn, concat(rpad(regexp_replace(upper(p_brand), '[^A-Z0-9]', 'X'), 14, '0'), '-', lvl, '-', lpad(concat('', 1 + p_partkey % 9), 3, '0')) AS ulpin_3d,
  rpad(regexp_replace(upper(p_brand), '[^A-Z0-9]', 'X'), 14, '0') AS parcel_ulpin, lvl AS level_code, 1 + p_partkey % 9 AS unit,
  CAST(n AS DOUBLE) * 3 AS base_m, CASE WHEN p_partkey % 41 = 0 THEN CAST(n AS DOUBLE) * 3 - 1 ELSE CAST(n AS DOUBLE) * 3 + 3 + CAST(p_partkey % 3 AS DOUBLE) / 4 END AS top_m,
  p_partkey % 4 = 0 AS footprint_is_parcel, CASE WHEN p_partkey % 5 = 0 THEN 1 + p_partkey % 3 END AS building,
  CAST(p_partkey % 50 AS DOUBLE) AS x0, floor(CAST(p_partkey AS DOUBLE) / 50) AS y0, CAST(p_partkey % 50 AS DOUBLE) + 0.5 + CAST(p_size AS DOUBLE) / 40 AS x1, floor(CAST(p_partkey AS DOUBLE) / 50) + 0.5 + CAST(p_size AS DOUBLE) / 40 AS y1
FROM (SELECT *, p_size % 6 AS n, CASE p_size % 6 WHEN 0 THEN 'G00' ELSE concat('F0', p_size % 6) END AS lvl FROM {part}) p""",
    # buildings and other points on the same plane
    "points": """
SELECT s_suppkey AS point_id, CAST(s_suppkey * 7 % 500 AS DOUBLE) / 10 AS x, CAST(s_suppkey * 13 % 400 AS DOUBLE) / 10 AS y, CAST(s_suppkey % 100 AS DOUBLE) / 100 AS confidence, 20 + s_suppkey % 180 AS area_m2
FROM {supplier}""",
    # state, district, tehsil, village
    "admin": """
SELECT DISTINCT r_name AS state, n_name AS district, c_mktsegment AS tehsil, concat('village ', c_custkey % 60) AS village
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # a registered parcel per customer
    "registry": """
SELECT concat('REG-', c_custkey) AS source_id, concat(c_custkey, '/', 1 + c_custkey % 9) AS khasra_number, concat('', c_custkey) AS khata_number, concat('village ', c_custkey % 60) AS village, n_name AS district,
  CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Someone Else' END AS owner_name, CAST(1000 + c_custkey % 9 * 700 AS DOUBLE) AS area_sqm, CASE c_custkey % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'forest' ELSE 'barren' END AS land_classification
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # a second registry: a parcel per supplier
    "registry_offices": """
SELECT concat('OFF-', s_suppkey) AS source_id, concat(s_suppkey % 500, '/', 1 + s_suppkey % 9) AS khasra_number, concat('', s_suppkey * 7 % 3000) AS khata_number, concat('village ', s_suppkey % 60) AS village, n_name AS district
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # heights sampled under the footprint of each supplier's building
    "heights": """
SELECT l_suppkey AS footprint_id, CASE WHEN l_partkey % 50 = 0 THEN -99.0 ELSE l_quantity * 0.3 - 0.5 END AS height_m
FROM {lineitem}""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The binding `name` over the tables in `sf_dir`."""
    text = re.sub(r"\[\[(\d+)\.\.(\d+)\]\]", r"explode(sequence(\1, \2))", BINDINGS[name])
    used = {t: base(spark, sf_dir, t) for t in BASE if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def ctes(*names: str) -> str:
    """WITH clause that defines the bindings for the checking SQL."""
    parts = []
    for name in names:
        text = re.sub(r"\[\[(\d+)\.\.(\d+)\]\]", lambda m: f"unnest(range({m[1]}, {int(m[2]) + 1}))", BINDINGS[name])
        text = text.replace("'[^A-Z0-9]', 'X')", "'[^A-Z0-9]', 'X', 'g')")
        for t in BASE:
            text = text.replace(f"{{{t}}}", t)
        parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts) + "\n"
