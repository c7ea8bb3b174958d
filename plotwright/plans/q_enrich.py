"""Queries over record correction, issue makers beyond the rules, and the composed pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import audit, correction, enrichment, measures, process, records, topology
from .bindings import TODAY, base, ctes, frame
from .q_rules import DECISION_SQL, confidence
from .registry import query

c = F.col


def _marks(spark, sf):
    """Marks on a record's page: none rendered for one in nine."""
    o = base(spark, sf, "orders")
    return o.select(
        c("o_orderkey").alias("id"), (c("o_custkey") % 3 == 0).alias("stamp"), F.when(c("o_orderkey") % 9 > 0, (c("o_custkey") % 4).cast("int")).alias("seals"), (c("o_custkey") % 5 > 0).alias("signature"),
        (c("o_orderkey") % 2 == 0).alias("registered"), (c("o_custkey") % 6).cast("int").alias("written"), (c("o_orderkey") % 11 > 0).alias("profiled"),
        F.when(c("o_orderkey") % 7 > 0, F.concat(F.lit("type "), (c("o_orderkey") % 7).cast("string"))).alias("kind"), F.when(c("o_orderkey") % 13 == 0, c("o_custkey")).alias("earlier"),
    )


MARKS = "m AS (SELECT o_orderkey AS id, o_custkey % 3 = 0 AS stamp, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey % 4 END AS seals, o_custkey % 5 > 0 AS signature, o_orderkey % 2 = 0 AS registered, o_custkey % 6 AS written, o_orderkey % 11 > 0 AS profiled, CASE WHEN o_orderkey % 7 > 0 THEN concat('type ', o_orderkey % 7) END AS kind, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey END AS earlier FROM orders)"


def _rows(df, column):
    return df.select("id", F.inline(column)).select("id", "rule", "severity", "message")


@query("WITH " + MARKS + """ SELECT id, 'STAMP_PAPER_DETECTED' AS rule, 'info' AS severity, 'printed on stamp paper' AS message FROM m WHERE seals IS NOT NULL AND stamp
UNION ALL SELECT id, 'SEAL_DETECTED', 'info', concat(seals, ' seal-like marks') FROM m WHERE seals > 0
UNION ALL SELECT id, 'SEAL_MISSING', 'warning', 'no seal-like mark was found' FROM m WHERE seals = 0
UNION ALL SELECT id, 'SIGNATURE_DETECTED', 'info', 'a signature-like mark was found' FROM m WHERE seals IS NOT NULL AND signature
UNION ALL SELECT id, 'SIGNATURE_MISSING', 'warning', 'registered, but no signature-like mark was found' FROM m WHERE seals IS NOT NULL AND NOT signature AND registered""")
def rule_authenticity(spark, sf):
    return _rows(_marks(spark, sf), enrichment.authenticity(c("stamp"), c("seals"), c("signature"), c("registered")))


@query("WITH " + MARKS + """ SELECT id, 'HANDWRITING_CHECK_UNAVAILABLE' AS rule, 'info' AS severity, 'no profile of printed text' AS message FROM m WHERE NOT profiled
UNION ALL SELECT id, 'HANDWRITING_SUSPECTED', 'warning', concat(written, ' lines look handwritten') FROM m WHERE profiled AND written > 0
UNION ALL SELECT id, 'DOCUMENT_TYPE', 'info', CASE WHEN kind IS NULL THEN 'not recognised; the full schema applies' ELSE concat('read as ', kind) END FROM m
UNION ALL SELECT id, 'FILE_ALREADY_UPLOADED', 'warning', concat('the same file is record ', earlier) FROM m WHERE earlier IS NOT NULL""")
def rule_scan_and_upload(spark, sf):
    return _rows(_marks(spark, sf), F.concat(enrichment.handwriting(c("written"), c("profiled")), enrichment.document_type(c("kind")), enrichment.uploaded_before(c("earlier"))))


@query("""WITH n AS (SELECT o_orderkey AS id, o_custkey % 100 AS baseline, o_orderkey % 4 = 0 AS odd, CASE o_orderkey % 3 WHEN 0 THEN 'locality' WHEN 1 THEN 'state' END AS level, CASE WHEN o_orderkey % 5 = 0 THEN 'a:b,c:d' ELSE '' END AS conflicts FROM orders)
SELECT id, 'ANOMALY_BASELINE_NOT_TRAINED' AS rule, 'info' AS severity FROM n WHERE baseline < 50 UNION ALL SELECT id, 'ANOMALY_DETECTED', 'warning' FROM n WHERE baseline >= 50 AND odd
UNION ALL SELECT id, 'GEO_PLACE_APPROXIMATE', 'info' FROM n WHERE level IS NOT NULL UNION ALL SELECT id, 'GEO_PLACE_CONFLICT', 'warning' FROM (SELECT id, unnest(str_split(conflicts, ',')) FROM n WHERE conflicts <> '')""")
def rule_anomaly_and_place(spark, sf):
    o = base(spark, sf, "orders")
    level = F.when(c("o_orderkey") % 3 == 0, "locality").when(c("o_orderkey") % 3 == 1, "state")
    found = F.concat(enrichment.anomaly(c("o_custkey") % 100, c("o_orderkey") % 4 == 0), enrichment.place(level, F.lit(5000), F.when(c("o_orderkey") % 5 == 0, "a:b,c:d").otherwise("")))
    return _rows(o.select(c("o_orderkey").alias("id"), found.alias("f")), c("f")).drop("message")


@query(ctes("rec_values") + """, f AS (SELECT id, 'owner_name' AS field_key, owner_name AS value, CASE id % 3 WHEN 0 THEN concat('sold by ', owner_name) WHEN 1 THEN 'Somebody Else' END AS said FROM rec_values WHERE coalesce(owner_name, '') <> ''
  UNION ALL SELECT id, 'registration_date', registration_date, CASE id % 2 WHEN 0 THEN strftime(registration_date::DATE, '%d/%m/%Y') END FROM rec_values WHERE registration_date IS NOT NULL)
SELECT id, field_key, CASE WHEN said IS NULL THEN 'NER_UNCONFIRMED' WHEN field_key = 'registration_date' OR id % 3 = 0 THEN 'NER_CONFIRMED' ELSE 'NER_MISMATCH' END AS rule, CASE WHEN said IS NOT NULL AND field_key = 'owner_name' AND id % 3 = 1 THEN 'warning' ELSE 'info' END AS severity FROM f""")
def rule_name_cross_check(spark, sf):
    v = frame(spark, sf, "rec_values")
    name, day = (v.select("id", F.lit(k).alias("field_key"), c(k).alias("value")) for k in ("owner_name", "registration_date"))
    said = F.when(c("id") % 3 == 0, F.concat(F.lit("sold by "), "value")).when(c("id") % 3 == 1, "Somebody Else")
    heard = name.select("id", "field_key", F.lit("PERSON").alias("label"), said.alias("text")).unionByName(day.where("id % 2 = 0").select("id", "field_key", F.lit("DATE").alias("label"), F.date_format(c("value").cast("date"), "dd/MM/yyyy").alias("text")))
    return enrichment.name_cross_check(name.unionByName(day), heard.where("text IS NOT NULL"))


@query("SELECT DISTINCT o_orderkey AS id, NULL::VARCHAR AS field_key, 'NER_UNAVAILABLE' AS rule, 'info' AS severity FROM orders")
def rule_name_check_unavailable(spark, sf):
    return enrichment.name_cross_check(frame(spark, sf, "rec_values").select("id", F.lit("owner_name").alias("field_key"), c("owner_name").alias("value")), None)


@query(ctes("rec_values") + """SELECT id, CASE WHEN coalesce(trim(khasra_number), '') = '' THEN NULL WHEN id % 5 = 0 OR id % 7 = 0 OR id % 11 = 0 THEN 'FACT_CHECK_NOT_FOUND' ELSE 'MATCHED' END AS status,
CASE WHEN coalesce(trim(khasra_number), '') <> '' AND NOT (id % 5 = 0 OR id % 7 = 0 OR id % 11 = 0) THEN concat('R', id) END AS source_id FROM rec_values""")
def rule_registry_status(spark, sf):
    """A nearest row for all but one in five; one in seven scores too low, one in eleven is another plot."""
    v = frame(spark, sf, "rec_values")
    near = v.where("id % 5 > 0").select("id", F.concat(F.lit("R"), c("id").cast("string")).alias("source_id"), F.when(c("id") % 7 == 0, 0.5).otherwise(0.9).alias("score"), F.when(c("id") % 11 == 0, "9999/9").otherwise(c("khasra_number")).alias("reg_khasra"))
    return enrichment.registry_status(v, near)


@query(ctes("rec_values") + "SELECT id, 'FACT_CHECK_NO_REGISTRY' AS status, NULL::VARCHAR AS source_id FROM rec_values")
def rule_no_registry(spark, sf):
    return enrichment.registry_status(frame(spark, sf, "rec_values"), None)


_SHARED = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(ctes("parcels") + f"""SELECT a.parcel_id AS a, b.parcel_id AS b, CASE WHEN a.document_id <> b.document_id THEN 'OVERLAPPING_CLAIM' ELSE 'PARCELS_OVERLAP' END AS rule, CASE WHEN a.document_id <> b.document_id THEN 'error' ELSE 'warning' END AS severity, round({_SHARED} + 1e-9, 1) AS m2
FROM parcels a JOIN parcels b ON a.parcel_id < b.parcel_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE {_SHARED} >= 0.2 - 1e-9""")
def rule_overlap_issues(spark, sf):
    """Boxes as polygons: the shared area comes from clipping one ring by the other."""
    p = frame(spark, sf, "parcels").withColumn("ring", g.box(*[c(x) for x in ("x0", "y0", "x1", "y1")]))
    shared = topology.shared_area(p, 1.0)
    owner = p.select("parcel_id", "document_id")
    j = shared.join(owner.withColumnsRenamed({"parcel_id": "a", "document_id": "doc_a"}), "a").join(owner.withColumnsRenamed({"parcel_id": "b", "document_id": "doc_b"}), "b")
    return enrichment.overlap_issues(j, 0.2)


@query(ctes("parcels") + "SELECT parcel_id AS id, 'GEOMETRY_INVALID' AS rule, 'error' AS severity FROM parcels WHERE parcel_id % 3 = 0")
def rule_geometry_invalid(spark, sf):
    """Every third ring is drawn as a bow tie."""
    ring = g.box(*[c(x) for x in ("x0", "y0", "x1", "y1")])
    at = lambda k: F.get(ring, k)
    drawn = F.when(c("parcel_id") % 3 == 0, F.array(at(0), at(2), at(1), at(3))).otherwise(ring)
    p = frame(spark, sf, "parcels").select(c("parcel_id").alias("id"), drawn.alias("ring"))
    return _rows(p, enrichment.invalid_geometry(g.problems(c("ring")))).drop("message")


CORRECTED = ctes("rec_values", "admin") + """, d AS (SELECT id, trim(district) AS value, n_name FROM rec_values LEFT JOIN nation ON n_name = district OR concat(n_name, 'X') = district WHERE trim(coalesce(district, '')) <> ''),
s AS (SELECT v.id, trim(v.state) AS value, r_name, (SELECT max(state) FROM admin a WHERE a.district = d.n_name) AS home FROM rec_values v JOIN region ON lower(r_name) = lower(trim(v.state)) LEFT JOIN d ON d.id = v.id WHERE trim(coalesce(v.state, '')) <> '')
SELECT id, 'district' AS field_key, value, CASE WHEN n_name = value THEN 'confirmed' ELSE 'corrected' END AS outcome, n_name AS new_value FROM d
UNION ALL SELECT id, 'state', value, CASE WHEN coalesce(lower(home) <> lower(r_name), false) THEN 'ambiguous' ELSE 'confirmed' END, CASE WHEN coalesce(lower(home) <> lower(r_name), false) THEN value ELSE r_name END FROM s
UNION ALL SELECT id, 'ulpin', ulpin, CASE WHEN regexp_matches(ulpin, '^[A-Z0-9]{14}$') THEN 'confirmed' ELSE 'invalid_shape' END, ulpin FROM rec_values WHERE coalesce(ulpin, '') <> ''
UNION ALL SELECT v.id, 'tehsil', trim(tehsil), CASE WHEN d.n_name IS NULL THEN 'no_vocabulary' WHEN EXISTS (SELECT 1 FROM admin a WHERE a.district = d.n_name AND a.tehsil = trim(v.tehsil)) THEN 'confirmed' ELSE 'not_found' END, trim(tehsil) FROM rec_values v LEFT JOIN d ON d.id = v.id WHERE trim(coalesce(tehsil, '')) <> ''"""


@query(CORRECTED)
def join_correct_record(spark, sf):
    m = correction.correct_record(frame(spark, sf, "rec_values"), frame(spark, sf, "admin"))
    return m.where("field_key IN ('district', 'state', 'ulpin', 'tehsil')").select("id", "field_key", "value", "outcome", "new_value")


@query()
def join_correct_village(spark, sf):
    """Villages within their tehsil or district, with scores; held against plain matching in the tests."""
    return correction.correct_record(frame(spark, sf, "rec_values"), frame(spark, sf, "admin")).where("field_key = 'village'")


@query(f"SELECT id, value, status, outcome FROM (SELECT id, new_value AS value, CASE WHEN outcome IN ('corrected', 'ambiguous', 'invalid_shape') THEN 'needs_review' ELSE 'extracted' END AS status, outcome FROM ({CORRECTED}) WHERE field_key = 'district')")
def join_apply_corrections(spark, sf):
    v = frame(spark, sf, "rec_values").where("trim(coalesce(district, '')) <> ''")
    fields = v.select("id", F.lit("district").alias("field_key"), c("district").alias("value"), F.lit("extracted").alias("status"))
    m = correction.correct_record(v, frame(spark, sf, "admin")).where("field_key = 'district'")
    return correction.apply_to_fields(fields, m).select("id", "value", "status", "outcome")


@query(f"SELECT id, concat('VOCAB_', upper(outcome)) AS rule, CASE outcome WHEN 'not_found' THEN 'info' WHEN 'no_vocabulary' THEN 'info' ELSE 'warning' END AS severity, field_key AS field FROM ({CORRECTED}) WHERE outcome <> 'confirmed'")
def rule_vocabulary(spark, sf):
    m = correction.correct_record(frame(spark, sf, "rec_values"), frame(spark, sf, "admin")).where("field_key IN ('district', 'state', 'ulpin', 'tehsil')")
    return enrichment.vocabulary(m).select("id", F.inline("issues")).select("id", "rule", "severity", "field")


@query(ctes("rec_values") + "SELECT id, 'LLM_SUGGESTION' AS rule, 'info' AS severity, 'owner_name' AS field, concat('suggested: ', upper(owner_name)) AS message FROM rec_values WHERE owner_name IS NOT NULL")
def rule_suggestions(spark, sf):
    said = frame(spark, sf, "rec_values").where("owner_name IS NOT NULL").select("id", F.lit("owner_name").alias("field_key"), F.upper("owner_name").alias("suggestion"))
    return enrichment.suggestions(said).select("id", F.inline("issues")).select("id", "rule", "severity", "field", "message")


@query(DECISION_SQL)
def process_revalidate(spark, sf):
    """Every record revalidated after its latest edits; here no edit changes a value."""
    v = frame(spark, sf, "rec_values")
    none = spark.createDataFrame([], "document_id long, field_key string, new_value string, confirm_only boolean, seq long")
    return process.revalidate(v, none, confidence, TODAY, frame(spark, sf, "admin")).select("id", "error_count", "warning_count", "info_count", "decision", "trust_score", "signature")


@query()
def process_documents(spark, sf):
    """Printed forms from lines to decisions; a hand-made document is followed through in the tests."""
    from .q_text import _form_lines

    return process.process(_form_lines(spark, sf), frame(spark, sf, "admin"), TODAY).select("id", "doc_type", "error_count", "warning_count", "decision", "trust_score")


@query(ctes("rec_documents", "rec_users") + "SELECT d.id, a.full_name AS uploader_name, b.full_name AS reviewer_name FROM (SELECT *, page_count AS reviewed_by FROM rec_documents) d LEFT JOIN rec_users a ON a.id = uploaded_by LEFT JOIN rec_users b ON b.id = reviewed_by")
def join_document_users(spark, sf):
    d = frame(spark, sf, "rec_documents").withColumn("reviewed_by", c("page_count"))
    return records.detail(d, frame(spark, sf, "rec_users")).select("id", "uploader_name", "reviewer_name")


@query(ctes("rec_documents", "rec_fields") + "SELECT id FROM (SELECT *, concat('page of ', ocr_engine) AS full_text FROM rec_documents) d WHERE filename ILIKE '%HIGH%' OR full_text ILIKE '%HIGH%' OR id IN (SELECT document_id FROM rec_fields WHERE value ILIKE '%HIGH%')")
def filter_search_full_text(spark, sf):
    d = frame(spark, sf, "rec_documents").withColumn("full_text", F.concat(F.lit("page of "), "ocr_engine"))
    return records.search(d, frame(spark, sf, "rec_fields"), "HIGH").select("id")


@query(ctes("rec_users") + "SELECT username, full_name, role, office FROM rec_users UNION ALL SELECT concat('new', s_suppkey), s_name, 'operator', 'office' FROM supplier")
def win_ensure_users(spark, sf):
    s = base(spark, sf, "supplier").select(F.concat(F.lit("new"), c("s_suppkey").cast("string")).alias("username"), c("s_name").alias("full_name"), F.lit("operator").alias("role"), F.lit("office").alias("office"))
    known = frame(spark, sf, "rec_users")
    return records.ensure_users(known, s.unionByName(known.select("username", F.lit("someone else").alias("full_name"), "role", "office")))


@query("""SELECT l_orderkey AS page, round(coalesce(avg(conf) FILTER (trim(word) <> '' AND conf >= 0), 0), 6) AS mean_confidence, coalesce(sum(length(trim(word))) FILTER (trim(word) <> '' AND conf >= 50), 0)::BIGINT AS confident_chars
FROM (SELECT l_orderkey, CASE l_linenumber WHEN 3 THEN ' ' ELSE concat(' ', l_returnflag) END AS word, (l_partkey % 120 - 10)::DOUBLE AS conf FROM lineitem) GROUP BY 1""")
def agg_reading_summary(spark, sf):
    w = base(spark, sf, "lineitem").select(c("l_orderkey").alias("page"), F.when(c("l_linenumber") == 3, " ").otherwise(F.concat(F.lit(" "), "l_returnflag")).alias("text"), (c("l_partkey") % 120 - 10).cast("double").alias("conf"))
    return measures.reading_summary(w, "page")


@query("SELECT p_brand AS map_id, string_agg(label, ',' ORDER BY n, label) AS labels FROM (SELECT DISTINCT p_brand, label, CASE WHEN regexp_matches(str_split(label, '/')[1], '^[0-9]+$') THEN str_split(label, '/')[1]::BIGINT ELSE 0 END AS n FROM (SELECT p_brand, CASE WHEN p_partkey % 5 = 0 THEN concat('x', p_size) ELSE concat(p_partkey % 40, '/', p_size) END AS label FROM part)) GROUP BY p_brand")
def agg_sorted_labels(spark, sf):
    label = F.when(c("p_partkey") % 5 == 0, F.concat(F.lit("x"), c("p_size").cast("string"))).otherwise(F.concat_ws("/", (c("p_partkey") % 40).cast("string"), c("p_size").cast("string")))
    p = base(spark, sf, "part").select(c("p_brand").alias("map_id"), label.alias("label")).distinct()
    g_ = p.groupBy("map_id").agg(F.array_sort(F.collect_list(t.label_order(c("label")))).alias("l"))
    return g_.select("map_id", F.array_join(F.transform("l", lambda x: x["label"]), ",").alias("labels"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'hi' WHEN 1 THEN 'ta' WHEN 2 THEN 'bn' END AS language, o_orderkey % 4 < 3 AS indic FROM orders")
def str_script_language(spark, sf):
    word = F.concat(c("o_orderpriority"), F.element_at(F.array(F.lit(" ग्राम"), F.lit(" கிராமம்"), F.lit(" গ্রাম"), F.lit(" gram")), (c("o_orderkey") % 4 + 1).cast("int")))
    return base(spark, sf, "orders").select("o_orderkey", t.script_language(word).alias("language"), t.is_indic(word).alias("indic"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN concat(p_partkey, '') ELSE concat(p_size, '/1') END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'geo' ELSE 'pixel' END AS source FROM part WHERE p_partkey % 6 <> 5")
def geo_rings_of(spark, sf):
    at = lambda x: F.array(F.struct(F.lit(float(x)).alias("x"), c("p_partkey").cast("double").alias("y")))
    p = base(spark, sf, "part").select(F.when(c("p_partkey") % 4 > 0, F.concat(c("p_size").cast("string"), F.lit("/1"))).alias("khasra_number"), c("p_partkey").alias("parcel_id"), F.when(c("p_partkey") % 2 == 0, at(1)).alias("geo_ring"), F.when(c("p_partkey") % 6 != 5, at(2)).alias("pixel_ring"))
    r = topology.rings_of(p)
    return r.select(F.get("ring", 0)["y"].cast("bigint").alias("p_partkey"), "name", F.when(F.get("ring", 0)["x"] == 1, "geo").otherwise("pixel").alias("source"))


@query("SELECT p_partkey AS sheet, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::INT AS dropped, CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 6 END::BIGINT AS points, true AS passed FROM part")
def math_control_fit_robust(spark, sf):
    """Six control points a sheet; on every second one the point in the middle is far off."""
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), c("point_id"))
    p = base(spark, sf, "part").select(c("p_partkey").alias("sheet"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("point_id"))
    p = p.withColumn("px", at((0, 1000, 0, 1000, 500, 500))).withColumn("py", at((0, 0, 1000, 1000, 500, 0)))
    wrong = F.when((c("point_id") == 5) & (c("sheet") % 2 == 0), 0.01).otherwise(0.0)
    points = p.select("*", (c("px") * 1e-5 + 80 + wrong).alias("lon"), (c("py") * -1e-5 + 25).alias("lat"))
    return measures.control_fit_robust(points, "sheet", most=2).select("sheet", "dropped", "points", "passed")


@query(ctes("rec_audit") + "SELECT document_id, count(*) AS entries, true AS ok FROM rec_audit GROUP BY document_id")
def audit_seal(spark, sf):
    """A log whose later half of each chain has lost its hashes is sealed again, and holds."""
    from .q_records import AUDIT, _log

    log = audit.build(_log(spark, sf), AUDIT, "document_id")
    halfway = _log(spark, sf).groupBy("document_id").agg(F.percentile_approx("id", 0.5).alias("mid"))
    cut = log.join(halfway, "document_id")
    cut = cut.withColumn("prev_hash", F.when(c("id") <= c("mid"), c("prev_hash"))).withColumn("entry_hash", F.when(c("id") <= c("mid"), c("entry_hash"))).drop("mid")
    return audit.verify(audit.seal(cut, AUDIT, "document_id"), AUDIT, "document_id").select("document_id", "entries", "ok")
