"""Queries over records: scans, filters, joins, aggregates, windows and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocab import REQUIRED
from ..operators import audit, measures, records, stats
from ..sources import sinks
from .bindings import base, ctes, frame
from .registry import query

DOCS, FIELDS, USERS = "rec_documents", "rec_fields", "rec_users"


@query(ctes(DOCS) + "SELECT status, count(*) AS c FROM rec_documents GROUP BY status")
def agg_by_status(spark, sf):
    return stats.by_status(frame(spark, sf, DOCS))


@query(ctes(DOCS) + "SELECT count(*) FILTER (status IN ('needs_review', 'blocked')) AS pending_verification FROM rec_documents")
def agg_pending(spark, sf):
    return stats.pending(frame(spark, sf, DOCS))


@query(ctes(DOCS) + "SELECT round(avg(trust_score), 1) AS avg_trust_score, round(avg(legibility), 1) AS avg_legibility, round(avg(mean_ocr_conf), 4) AS avg_ocr_confidence, floor(avg(processing_ms))::BIGINT AS avg_processing_ms FROM rec_documents")
def agg_averages(spark, sf):
    return stats.averages(frame(spark, sf, DOCS))


@query(ctes(DOCS, FIELDS) + "SELECT coalesce(f.value, 'Unassigned') AS district, count(*) AS c, round(avg(d.trust_score), 1) AS avg_trust FROM rec_documents d LEFT JOIN rec_fields f ON f.document_id = d.id AND f.field_key = 'district' GROUP BY 1 ORDER BY c DESC, district LIMIT 12")
def agg_by_district_top12(spark, sf):
    return stats.by_district(frame(spark, sf, DOCS), frame(spark, sf, FIELDS))


@query(ctes(DOCS) + "SELECT coalesce(ocr_engine, 'unknown') AS engine, count(*) AS c, round(avg(trust_score), 1) AS avg_trust FROM rec_documents GROUP BY 1")
def agg_by_engine(spark, sf):
    return stats.by_engine(frame(spark, sf, DOCS))


ACCURACY = """SELECT field_key, total, corrected, confirmed, missing, avg_conf, corrected + confirmed AS reviewed, CASE WHEN corrected + confirmed > 0 THEN round(1 - corrected / (corrected + confirmed), 4) END AS precision
FROM (SELECT field_key, count(*) AS total, count(*) FILTER (status = 'corrected') AS corrected, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (value IS NULL) AS missing, round(avg(ai_confidence), 4) AS avg_conf FROM rec_fields GROUP BY field_key)"""


@query(ctes(FIELDS) + ACCURACY)
def agg_field_accuracy(spark, sf):
    return stats.field_accuracy(frame(spark, sf, FIELDS))


@query(ctes(FIELDS) + f"SELECT field_key, reviewed, precision FROM ({ACCURACY})")
def agg_field_precision(spark, sf):
    return stats.field_accuracy(frame(spark, sf, FIELDS)).select("field_key", "reviewed", "precision")


@query(ctes("rec_corrections", FIELDS) + "SELECT c AS corrections_total, f AS fields_reviewed, round(1 - c / f, 4) AS extraction_precision FROM (SELECT count(*) AS c FROM rec_corrections), (SELECT count(*) AS f FROM rec_fields WHERE status IN ('corrected', 'confirmed'))")
def agg_overall_precision(spark, sf):
    return stats.overall_precision(frame(spark, sf, "rec_corrections"), frame(spark, sf, FIELDS))


@query(ctes(DOCS, "rec_corrections", FIELDS) + "SELECT 'documents_total' AS name, count(*) AS n FROM rec_documents UNION ALL SELECT 'corrections_total', count(*) FROM rec_corrections UNION ALL SELECT 'fields_reviewed', count(*) FROM rec_fields WHERE status IN ('corrected', 'confirmed')")
def agg_totals(spark, sf):
    return stats.totals(frame(spark, sf, DOCS), frame(spark, sf, "rec_corrections"), frame(spark, sf, FIELDS))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS c FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def agg_daily_volume(spark, sf):
    return stats.daily_volume(base(spark, sf, "events"), "ts")


_REQ = ", ".join(f"'{k}'" for k in REQUIRED)


@query(ctes(FIELDS) + f"""SELECT document_id, count(*) AS fields_total, count(value) AS fields_extracted, round(count(value) / count(*), 4) AS completeness,
  coalesce(string_agg(field_key, ',' ORDER BY field_key) FILTER (value IS NULL AND field_key IN ({_REQ})), '') AS required_missing,
  coalesce(string_agg(field_key, ',' ORDER BY field_key) FILTER (value IS NOT NULL AND ai_confidence < 0.80), '') AS low_confidence_fields,
  coalesce(round(avg(ai_confidence) FILTER (value IS NOT NULL), 4), 0) AS mean_field_confidence FROM rec_fields GROUP BY document_id""")
def agg_doc_summary(spark, sf):
    return stats.document_summary(frame(spark, sf, FIELDS), REQUIRED)


@query(ctes(FIELDS) + "SELECT document_id, field_key, value, status FROM rec_fields WHERE status = 'needs_review' AND ai_confidence < 0.5")
def filter_status(spark, sf):
    return frame(spark, sf, FIELDS).where("status = 'needs_review' AND ai_confidence < 0.5").select("document_id", "field_key", "value", "status")


@query(ctes(DOCS, FIELDS) + "SELECT id, filename, status FROM rec_documents WHERE filename ILIKE '%77%' OR id IN (SELECT document_id FROM rec_fields WHERE value ILIKE '%77%')")
def filter_search_ilike_or_in(spark, sf):
    return records.search(frame(spark, sf, DOCS), frame(spark, sf, FIELDS), "77").select("id", "filename", "status")


@query(ctes(DOCS, FIELDS) + "SELECT d.id FROM rec_documents d WHERE d.status = 'approved' AND EXISTS (SELECT 1 FROM rec_fields f WHERE f.document_id = d.id AND f.value ILIKE '%china%')")
def join_semi_search(spark, sf):
    hits = frame(spark, sf, FIELDS).where(F.col("value").ilike("%china%"))
    docs = frame(spark, sf, DOCS).where("status = 'approved'")
    return docs.join(hits, docs["id"] == hits["document_id"], "left_semi").select("id")


@query(ctes("volumes") + "SELECT ulpin_3d, level_code, unit FROM volumes WHERE parcel_ulpin = 'BRANDX120000000' OR parcel_ulpin LIKE 'BRANDX1%'")
def filter_vertical_by_parcel(spark, sf):
    return frame(spark, sf, "volumes").where("parcel_ulpin = 'BRANDX120000000' OR parcel_ulpin LIKE 'BRANDX1%'").select("ulpin_3d", "level_code", "unit")


@query(ctes("points") + "SELECT point_id, x, y FROM points WHERE x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 25 AND confidence >= 0.70")
def filter_bbox_confidence(spark, sf):
    return frame(spark, sf, "points").where("x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 25 AND confidence >= 0.70").select("point_id", "x", "y")


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def filter_doc_by_hash(spark, sf):
    d = base(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(ctes(DOCS, USERS) + "SELECT d.id, d.status, u.full_name AS uploader_name, u.role FROM rec_documents d LEFT JOIN rec_users u ON u.id = d.uploaded_by")
def join_doc_users(spark, sf):
    u = frame(spark, sf, USERS).select(F.col("id").alias("user_id"), F.col("full_name").alias("uploader_name"), "role")
    return frame(spark, sf, DOCS).join(u, F.col("uploaded_by") == F.col("user_id"), "left").select("id", "status", "uploader_name", "role")


@query(ctes(FIELDS, USERS) + "SELECT f.document_id, f.field_key, u.full_name AS corrector, u.role AS corrector_role FROM rec_fields f LEFT JOIN rec_users u ON u.id = f.corrected_by WHERE f.status = 'corrected'")
def join_fields_corrector(spark, sf):
    return records.with_corrector(frame(spark, sf, FIELDS).where("status = 'corrected'"), frame(spark, sf, USERS)).select("document_id", "field_key", "corrector", "corrector_role")


@query(ctes(DOCS, FIELDS) + "SELECT d.id, f.value AS village FROM rec_documents d LEFT JOIN rec_fields f ON f.document_id = d.id AND f.field_key = 'village'")
def join_eav_left_on_pred(spark, sf):
    return stats.with_field(frame(spark, sf, DOCS), frame(spark, sf, FIELDS), "village", "village").select("id", "village")


_SCALAR = ", ".join(f"(SELECT value FROM rec_fields f WHERE f.document_id = d.id AND f.field_key = '{k}') AS {k}" for k in ("owner_name", "village", "area"))


@query(ctes(DOCS, FIELDS) + f"SELECT d.id, {_SCALAR} FROM rec_documents d")
def join_eav_scalar_subquery(spark, sf):
    w = records.wide(frame(spark, sf, FIELDS), ("owner_name", "village", "area"))
    return frame(spark, sf, DOCS).select("id").join(w, F.col("id") == F.col("document_id"), "left").drop("document_id")


_MAXES = ", ".join(f"max(value) FILTER (field_key = '{k}') AS {k}" for k in records.SHOWN)


@query(ctes(FIELDS) + f"SELECT document_id, {_MAXES} FROM rec_fields GROUP BY document_id")
def join_eav_pivot(spark, sf):
    return records.wide(frame(spark, sf, FIELDS))


@query(ctes(DOCS, USERS, FIELDS) + f"SELECT d.id, d.filename, d.status, u.full_name AS uploader_name, {', '.join('w.' + k for k in records.SHOWN)} FROM rec_documents d LEFT JOIN rec_users u ON u.id = d.uploaded_by LEFT JOIN (SELECT document_id, {_MAXES} FROM rec_fields GROUP BY document_id) w ON w.document_id = d.id ORDER BY d.id DESC LIMIT 100 OFFSET 200")
def topk_queue_page(spark, sf):
    # the page is cut first, so that only its rows are joined
    page = records.page(frame(spark, sf, DOCS), 100, 200)
    return records.listing(page, frame(spark, sf, USERS), frame(spark, sf, FIELDS)).select("id", "filename", "status", "uploader_name", *records.SHOWN)


@query(ctes(DOCS) + "SELECT a.id AS document_id, b.id AS earlier_id, a.signature FROM rec_documents a JOIN rec_documents b ON a.signature = b.signature AND b.id < a.id")
def join_dup_signature(spark, sf):
    return records.other_signatures(frame(spark, sf, DOCS)).select("document_id", "earlier_id", "signature")


@query(ctes(FIELDS) + "SELECT document_id, string_agg(concat(field_key, '=', coalesce(value, '')), ';' ORDER BY field_key) AS vals, round(sum(CASE WHEN status IN ('confirmed', 'corrected') THEN 1 ELSE coalesce(ai_confidence, 0) END), 6) AS total_confidence FROM rec_fields GROUP BY document_id")
def arr_values_map(spark, sf):
    m = records.values_map(frame(spark, sf, FIELDS))
    entries = F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["value"], F.lit(""))))
    total = F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, v: a + v["confidence"])
    return m.select("document_id", F.array_join(entries, ";").alias("vals"), F.round(total, 6).alias("total_confidence"))


def _edits(spark, sf):
    """Two edits of each field: the later one counts."""
    f = frame(spark, sf, FIELDS)
    e = f.select("document_id", "field_key", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "k", "value")
    return e.select("document_id", "field_key", "seq", F.when(F.col("k") % 2 == 0, F.concat(F.lit("new "), F.col("seq").cast("string"))).otherwise(F.col("value")).alias("new_value"), (F.col("k") == 5).alias("confirm_only"))


@query(ctes(FIELDS) + """SELECT document_id, field_key, value AS old_value, CASE WHEN k % 2 = 0 THEN 'new 2' ELSE value END AS value, CASE WHEN k % 2 = 1 THEN 'confirmed' ELSE 'corrected' END AS status, true AS edited FROM rec_fields""")
def win_latest_upsert(spark, sf):
    return records.apply_edits(frame(spark, sf, FIELDS), _edits(spark, sf))


@query(ctes(FIELDS) + "SELECT document_id, field_key, value AS ai_value, 'new 2' AS human_value FROM rec_fields WHERE k % 2 = 0")
def join_corrections_from_edits(spark, sf):
    return records.corrections_of(records.apply_edits(frame(spark, sf, FIELDS), _edits(spark, sf)))


@query(ctes(DOCS) + """SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN error_count > 0 THEN 'refused' ELSE 'approved' END WHEN id % 3 = 1 THEN CASE WHEN id % 2 = 0 THEN 'rejected' ELSE 'refused' END END AS outcome,
  CASE WHEN id % 3 = 0 AND error_count = 0 THEN 'approved' WHEN id % 3 = 1 AND id % 2 = 0 THEN 'rejected' ELSE status END AS new_status FROM rec_documents""")
def filter_review_decisions(spark, sf):
    d = frame(spark, sf, DOCS)
    asked = d.where("id % 3 < 2").select(F.col("id").alias("document_id"), F.when(F.col("id") % 3 == 0, "approve").otherwise("reject").alias("decision_asked"), F.when(F.col("id") % 2 == 0, "too blurred").otherwise(" no ").alias("reason"))
    return records.decide(d, asked).select("id", "outcome", "new_status")


@query(ctes(USERS) + "SELECT id, role, CASE role WHEN 'operator' THEN 'upload,correct' WHEN 'verifier' THEN 'upload,correct,approve,reject,revalidate' WHEN 'admin' THEN 'upload,correct,approve,reject,revalidate,retrain,export,purge' ELSE '' END AS rights FROM rec_users")
def join_role_rights(spark, sf):
    return records.rights(frame(spark, sf, USERS))


@query(ctes("parcels", DOCS) + "SELECT p.parcel_id, d.id AS linked_document FROM parcels p LEFT JOIN (SELECT id % 97 AS n, max(id) AS id FROM rec_documents WHERE status <> 'blocked' GROUP BY 1) d ON p.document_id = d.n")
def join_link_newest_doc(spark, sf):
    d = frame(spark, sf, DOCS).where("status <> 'blocked'").withColumn("n", F.col("id") % 97)
    newest = records.latest(d, ["n"], [F.desc("id")]).select("n", F.col("id").alias("linked_document"))
    return frame(spark, sf, "parcels").join(newest, F.col("document_id") == F.col("n"), "left").select("parcel_id", "linked_document")


@query(ctes("parcels") + "SELECT khasra_number, parcel_id, map_id FROM (SELECT *, row_number() OVER (PARTITION BY khasra_number ORDER BY parcel_id DESC) AS rn FROM parcels) WHERE rn = 1")
def win_newest_per_khasra(spark, sf):
    return records.latest(frame(spark, sf, "parcels"), ["khasra_number"], [F.desc("parcel_id")]).select("khasra_number", "parcel_id", "map_id")


@query(ctes("registry", "parcels") + "SELECT khasra_number, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT khasra_number, 'registry' AS source FROM registry UNION ALL SELECT khasra_number, 'map' FROM parcels) GROUP BY khasra_number")
def set_identifier_authority(spark, sf):
    both = frame(spark, sf, "registry").select("khasra_number", F.lit("registry").alias("source")).unionByName(frame(spark, sf, "parcels").select("khasra_number", F.lit("map").alias("source")))
    return both.groupBy("khasra_number").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


AUDIT = ("at", "user_id", "action", "document_id", "detail")


def _log(spark, sf):
    return frame(spark, sf, "rec_audit").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query()
def audit_chain_build(spark, sf):
    return audit.build(_log(spark, sf), AUDIT, "document_id").select("id", "document_id", "prev_hash", "entry_hash")


@query(ctes("rec_audit") + "SELECT document_id, true AS ok, count(*) AS entries, count(*) AS verified, NULL::BIGINT AS broken_at, NULL::VARCHAR AS reason FROM rec_audit GROUP BY document_id")
def audit_verify_ok(spark, sf):
    return audit.verify(audit.build(_log(spark, sf), AUDIT, "document_id"), AUDIT, "document_id")


@query(ctes("rec_audit") + """, n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id) AS rn FROM rec_audit)
SELECT document_id, document_id % 4 > 1 OR (document_id % 4 < 2 AND count(*) < 3) AS ok, count(*) FILTER (NOT (document_id % 4 = 0 AND rn = 2 AND c >= 3)) AS entries,
  CASE WHEN document_id % 4 > 1 OR max(c) < 3 THEN count(*) ELSE 0 END AS verified, CASE WHEN max(c) < 3 THEN NULL WHEN document_id % 4 = 0 THEN max(id) FILTER (rn = 3) WHEN document_id % 4 = 1 THEN max(id) FILTER (rn = 3) END AS broken_at,
  CASE WHEN max(c) < 3 THEN NULL WHEN document_id % 4 = 0 THEN 'broken_link' WHEN document_id % 4 = 1 THEN 'content_altered' END AS reason
FROM (SELECT *, count(*) OVER (PARTITION BY document_id) AS c FROM n) GROUP BY document_id""")
def audit_verify_tampered(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("document_id")
    log = audit.build(_log(spark, sf), AUDIT, "document_id").withColumn("rn", F.row_number().over(w.orderBy("id"))).withColumn("c", F.count("*").over(w))
    log = log.where(~((F.col("document_id") % 4 == 0) & (F.col("rn") == 2) & (F.col("c") >= 3)))
    forged = F.when((F.col("document_id") % 4 == 1) & (F.col("rn") == 3), F.lit("forged")).otherwise(F.col("detail"))
    return audit.verify(log.withColumn("detail", forged), AUDIT, "document_id")


@query(ctes("rec_audit") + "SELECT id, action, document_id FROM rec_audit WHERE document_id = 7 ORDER BY id DESC LIMIT 200")
def audit_trail(spark, sf):
    return audit.trail(frame(spark, sf, "rec_audit"), 7).select("id", "action", "document_id")


@query("SELECT event_id, concat('{\"action\":\"', event_type, '\",\"id\":', event_id, ',\"user_id\":', user_id, '}') AS payload, sha256(concat(repeat('0', 64), chr(10), '{\"action\":\"', event_type, '\",\"id\":', event_id, ',\"user_id\":', user_id, '}')) AS digest FROM events")
def json_canonical(spark, sf):
    e = base(spark, sf, "events").select("event_id", F.col("event_id").alias("id"), F.col("event_type").alias("action"), "user_id")
    payload = audit.canonical("user_id", "id", "action")
    return e.select("event_id", payload.alias("payload"), audit.digest(F.lit(None).cast("string"), payload).alias("digest"))


@query(ctes(DOCS, FIELDS) + f"SELECT d.id, d.filename, d.status, d.trust_score, {', '.join('w.' + k for k in records.SHOWN)} FROM (SELECT * FROM rec_documents ORDER BY id DESC LIMIT 5000) d LEFT JOIN (SELECT document_id, {_MAXES} FROM rec_fields GROUP BY document_id) w ON w.document_id = d.id")
def sink_export_wide(spark, sf):
    return sinks.wide_rows(sinks.newest(frame(spark, sf, DOCS)), frame(spark, sf, FIELDS), records.SHOWN)


@query()
def sink_export_nested(spark, sf):
    return sinks.nested_rows(sinks.newest(frame(spark, sf, DOCS)), frame(spark, sf, FIELDS))


@query(ctes("heights") + """, v AS (SELECT footprint_id, height_m, height_m BETWEEN 0 AND 400 AS fine FROM heights),
g AS (SELECT footprint_id, list(height_m ORDER BY height_m) FILTER (fine) AS h, count(*) FILTER (NOT fine) AS dropped FROM v GROUP BY footprint_id),
m AS (SELECT footprint_id, h, dropped, coalesce(len(h), 0) AS n FROM g),
r AS (SELECT footprint_id, CASE WHEN n >= 8 THEN round(h[n], 2) END AS max_m, CASE WHEN n >= 8 THEN round(h[least(n - 1, floor(n * 0.95))::INT + 1], 2) END AS p95_m, CASE WHEN n >= 8 THEN round(h[least(n - 1, floor(n * 0.5))::INT + 1], 2) END AS median_m,
  CASE WHEN n >= 8 THEN round(list_sum(h) / n, 2) END AS mean_m, CASE WHEN n >= 8 THEN round(len(list_filter(h, lambda x: x > 0.5)) / n, 3) END AS built_fraction, n::BIGINT AS samples, dropped FROM m)
SELECT *, CASE WHEN built_fraction >= 0.1 THEN p95_m END AS height_m FROM r""")
def agg_height_stats(spark, sf):
    return measures.height_stats(frame(spark, sf, "heights"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS words, round(least(1.0, exp(avg(ln(greatest(l_discount * 10, 0.01))))), 4) AS confidence FROM lineitem GROUP BY 1, 2")
def agg_ocr_line_confidence(spark, sf):
    words = base(spark, sf, "lineitem").withColumn("conf", F.col("l_discount") * 10)
    return measures.line_confidence(words, ["l_orderkey", "l_linenumber"], "conf")


@query("SELECT l_shipyear AS k, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(greatest(coalesce(stddev_samp(l_quantity), 0), abs(avg(l_quantity)) * 0.05, 1e-3), 6) AS std, round(quantile_cont(l_quantity, 0.5), 6) AS q500, round(quantile_cont(l_quantity, 0.95), 6) AS q950, round(quantile_cont(l_quantity, 0.995), 6) AS q995 FROM (SELECT year(l_shipdate) AS l_shipyear, l_quantity FROM lineitem) GROUP BY 1")
def agg_print_profile(spark, sf):
    return measures.print_profile(base(spark, sf, "lineitem").withColumn("k", F.year("l_shipdate").cast("long")), "k", "l_quantity")


@query(ctes(FIELDS) + """SELECT field_key, sum((t = f)::INT)::BIGINT AS correct, sum((t <> f)::INT)::BIGINT AS wrong, sum((t IS NOT NULL AND f IS NULL)::INT)::BIGINT AS missed, sum((t IS NULL AND f IS NOT NULL)::INT)::BIGINT AS spurious,
  round(sum((t = f)::INT) / (sum((t = f)::INT) + sum((t <> f)::INT) + sum((t IS NULL AND f IS NOT NULL)::INT)), 4) AS precision, round(sum((t = f)::INT) / (sum((t = f)::INT) + sum((t <> f)::INT) + sum((t IS NOT NULL AND f IS NULL)::INT)), 4) AS recall
FROM (SELECT field_key, CASE WHEN document_id % 8 = 0 THEN NULL WHEN status = 'corrected' THEN concat(value, '*') ELSE value END AS t, value AS f FROM rec_fields) GROUP BY field_key""".replace("sum((t = f)::INT)", "coalesce(sum((t = f)::INT), 0)").replace("sum((t <> f)::INT)", "coalesce(sum((t <> f)::INT), 0)"))
def agg_extraction_accuracy(spark, sf):
    f = frame(spark, sf, FIELDS)
    truth = f.select("document_id", "field_key", F.when(F.col("status") == "corrected", F.concat("value", F.lit("*"))).otherwise(F.col("value")).alias("value")).where("document_id % 8 <> 0")
    return measures.accuracy(truth, f.select("document_id", "field_key", "value"), ["document_id", "field_key"])


@query(ctes(FIELDS, DOCS) + """SELECT d.id, coalesce(d.legibility, 100) AS legibility, count(f.value) AS fields_extracted, coalesce(round(avg(f.ai_confidence) FILTER (f.value IS NOT NULL), 4), 0) AS mean_field_confidence, d.error_count, d.warning_count
FROM rec_documents d JOIN rec_fields f ON f.document_id = d.id GROUP BY d.id, d.legibility, d.error_count, d.warning_count""")
def agg_anomaly_features(spark, sf):
    s = stats.document_summary(frame(spark, sf, FIELDS), REQUIRED)
    d = frame(spark, sf, DOCS)
    return d.join(s, F.col("id") == F.col("document_id")).select("id", F.coalesce("legibility", F.lit(100.0)).alias("legibility"), "fields_extracted", "mean_field_confidence", "error_count", "warning_count")


@query("""WITH m AS (SELECT o_orderpriority AS k, median(o_totalprice) AS med FROM orders GROUP BY 1), d AS (SELECT o_orderkey, k, abs(o_totalprice - med) AS dev FROM orders JOIN m ON o_orderpriority = k), s AS (SELECT k, median(dev) AS mad FROM d GROUP BY k)
SELECT o_orderkey, round(CASE WHEN mad > 0 THEN dev * 0.6745 / mad ELSE 0 END, 4) AS robust_z, CASE WHEN mad > 0 THEN dev * 0.6745 / mad ELSE 0 END > 3.5 AS anomalous FROM d JOIN s USING (k)""")
def agg_robust_outliers(spark, sf):
    o = base(spark, sf, "orders").withColumn("k", F.col("o_orderpriority"))
    return measures.robust_outliers(o, "o_totalprice", "k").select("o_orderkey", "robust_z", "anomalous")


@query("""WITH b AS (SELECT l_orderkey AS line, l_partkey AS x, l_quantity AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS box_id FROM lineitem),
g AS (SELECT *, greatest(0, x - lag(x + w) OVER (PARTITION BY line ORDER BY x, box_id)) AS gap FROM b),
m AS (SELECT line, median(gap) AS median_gap FROM g WHERE gap > 0 GROUP BY line)
SELECT line, max(seg) + 1 AS segments FROM (SELECT g.line, sum(CASE WHEN gap > median_gap * 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY g.line ORDER BY x, box_id)::BIGINT AS seg FROM g LEFT JOIN m ON g.line = m.line) GROUP BY line""")
def win_gap_segments(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    b = base(spark, sf, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_partkey").cast("double").alias("x"), F.col("l_quantity").alias("w"), F.row_number().over(w).alias("box_id"))
    return measures.gap_segments(b, "line", 1.5).groupBy("line").agg((F.max("seg") + 1).alias("segments"))

