"""Operators on small records: rules, the audit chain, extraction, learning, streams."""

import pytest
from pyspark.sql import functions as F

from plotwright.functions import geometry
from plotwright.functions.vocab import FIELD
from plotwright.operators import audit, extraction, learning, records, registry, rules, spatial, topology, vertical
from plotwright.plans.catalog import QUERIES
from plotwright.streaming import ingest

GOOD = {"khasra_number": "142/2", "khata_number": "87", "owner_name": "Ram Prasad Yadav", "area": "0.4820 hectare", "village": "Rampur", "district": "Lucknow"}


def record(spark, **over):
    row = {k: (GOOD | over).get(k) for k in FIELD}
    return spark.createDataFrame([(1, *row.values())], "id long, " + ", ".join(f"{k} string" for k in FIELD))


def issues(spark, column, **over):
    return [(i.rule, i.severity, i.field) for i in record(spark, **over).select(column.alias("i")).first().i]


@pytest.mark.parametrize("key", ["khata_number", "owner_name", "area", "village", "district"])
def test_each_required_field(spark, key):
    assert issues(spark, rules.required_fields(), **{key: ""}) == [("REQUIRED_MISSING", "error", key)]


def test_either_identifier_will_do(spark):
    assert issues(spark, rules.required_fields(), khasra_number=None, survey_number="12") == []
    assert issues(spark, rules.required_fields(), khasra_number=None) == [("REQUIRED_MISSING", "error", "khasra_number")]
    assert issues(spark, rules.required_fields("plot_report"), village=None, district=None) == []


@pytest.mark.parametrize(
    ("area", "want"),
    [("0.4820 hectare", []), ("blah", [("AREA_UNPARSED", "error")]), ("12", [("AREA_UNIT_MISSING", "error")]), ("0 acre", [("AREA_NON_POSITIVE", "error")]), ("0.3 sqm", [("AREA_RANGE", "error")]), ("3 sqm", [("AREA_RANGE", "warning")]), ("500 hectare", [("AREA_RANGE", "warning")]), ("5000 hectare", [("AREA_RANGE", "error")]), ("2 bigha", [("AREA_REGIONAL_UNIT", "info")])],
)
def test_areas(spark, area, want):
    assert [x[:2] for x in issues(spark, rules.area_sanity(), area=area)] == want


@pytest.mark.parametrize(
    ("share", "want"), [("1/2", []), ("7/5", ["SHARE_OVER_UNITY"]), ("1/0", ["SHARE_INVALID"]), ("150%", ["SHARE_OVER_UNITY"]), ("0%", ["SHARE_INVALID"]), ("whole", [])]
)
def test_shares(spark, share, want):
    assert [x[0] for x in issues(spark, rules.ownership(), share=share)] == want


def test_dates(spark):
    today = "2020-01-01"
    assert [x[0] for x in issues(spark, rules.dates(today), mutation_date="2021-01-01")] == ["DATE_FUTURE"]
    assert [x[0] for x in issues(spark, rules.dates(today), registration_date="1840-01-01")] == ["DATE_TOO_OLD"]
    assert [x[0] for x in issues(spark, rules.dates(today), mutation_date="12/03/2019")] == ["DATE_UNPARSED"]
    assert [x[0] for x in issues(spark, rules.dates(today), mutation_date="2010-01-01", registration_date="2011-01-01")] == ["DATE_ORDER"]


def test_placeholders_and_formats(spark):
    assert issues(spark, rules.placeholders(), owner_name="N/A") == [("PLACEHOLDER_VALUE", "error", "owner_name")]
    assert issues(spark, rules.placeholders(), owner_name="--") == []
    assert [x[0] for x in issues(spark, rules.identifier_formats(), khasra_number="000")] == ["IDENTIFIER_ZERO"]


def validated(spark, confidence=0.95, **over):
    return rules.validate(record(spark, **over), lambda k: F.lit(confidence), "2020-01-01").first()


def test_decisions(spark):
    good = validated(spark)
    assert (good.decision, good.error_count, good.warning_count, good.info_count, good.trust_score) == ("auto_approved", 0, 0, 1, 95.0)
    assert good.signature == "1422|rampur|lucknow"
    bad = validated(spark, village=None)
    assert bad.decision == "blocked" and bad.trust_score == pytest.approx(77.0) and bad.signature is None
    assert validated(spark, confidence=0.70).decision == "needs_review"
    assert validated(spark, confidence=0.50).decision == "blocked"


def test_duplicates(spark):
    cols = "id long, " + ", ".join(f"{k} string" for k in FIELD)
    rows = [(i, *[(GOOD | {"owner_name": o}).get(k) for k in FIELD]) for i, o in ((1, "A"), (2, "a"), (3, "B"), (4, None))]
    got = {(r.id, r.earlier_id): r.rule for r in rules.duplicates(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(2, 1): "DUPLICATE", (3, 1): "DUPLICATE_CONFLICT", (3, 2): "DUPLICATE_CONFLICT", (4, 1): "DUPLICATE", (4, 2): "DUPLICATE", (4, 3): "DUPLICATE"}


AUDIT = ("at", "action", "new_value")


def chain(spark):
    log = spark.createDataFrame([(i, f"2020-01-0{i}", a, v) for i, a, v in ((1, "ingested", None), (2, "corrected", "राम प्रसाद"), (3, "approved", "x"))], "id long, at string, action string, new_value string")
    return audit.build(log, AUDIT)


def test_chain_is_the_stated_digest(spark):
    import hashlib
    import json

    rows = chain(spark).orderBy("id").collect()
    before = None
    for r in rows:
        payload = json.dumps({k: r[k] for k in AUDIT}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert r.prev_hash == before
        before = hashlib.sha256(((before or "0" * 64) + "\n" + payload).encode()).hexdigest()
        assert r.entry_hash == before


def test_long_chains_fold_in_one_pass_and_entries_without_a_chain_stay(spark):
    import hashlib

    log = spark.range(12_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(7)).alias("document_id"), F.lit("read").alias("action"))
    rows = audit.build(log, ("action", "id"), "document_id").orderBy("id").collect()
    assert len(rows) == 12_000
    tip = {}
    for r in rows:
        assert r.prev_hash == tip.get(r.document_id)
        tip[r.document_id] = hashlib.sha256((tip.get(r.document_id, "0" * 64) + f'\n{{"action":"read","id":{r.id}}}').encode()).hexdigest()
        assert r.entry_hash == tip[r.document_id]
    holes = spark.createDataFrame(rows).withColumns({c: F.when(F.col("id") % 1000 < 400, F.col(c)) for c in ("prev_hash", "entry_hash")})
    sealed = audit.seal(holes, ("action", "id"), "document_id")
    assert sorted(sealed.select(*rows[0].__fields__).collect(), key=lambda r: r.id) == rows
    assert "collect_list" not in sealed._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    ("tamper", "want"),
    [
        (lambda d: d, (True, 3, 3, None, None)),
        (lambda d: d.where("id <> 2"), (False, 2, 0, 3, "broken_link")),
        (lambda d: d.withColumn("new_value", F.when(F.col("id") == 2, "sita").otherwise(F.col("new_value"))), (False, 3, 0, 2, "content_altered")),
        (lambda d: d.withColumn("at", F.when(F.col("id") == 1, "1999-01-01").otherwise(F.col("at"))), (False, 3, 0, 1, "content_altered")),
    ],
)
def test_tampering_shows(spark, tamper, want):
    stored = spark.createDataFrame(chain(spark).collect(), chain(spark).schema)
    r = audit.verify(tamper(stored), AUDIT).first()
    assert (r.ok, r.entries, r.verified, r.broken_at, r.reason) == want


def test_extraction(spark):
    lines = ["खसरा संख्या / Khasra No : 213/1", "Owner Name : Shri Ram Prasad", "Plot Area: 2 बीघा 10 बिस्वा", "Village :", "Rampur", "possession of the plot no 55 and in the land of his", "Khata No: 00620  District: Lucknow"]
    df = spark.createDataFrame([(1, i, x, 0.95) for i, x in enumerate(lines)], "doc long, line_no int, text string, ocr double")
    got = {r.field_key: r for r in extraction.extract_fields(df).collect()}
    assert {k: got[k].value for k in ("khasra_number", "owner_name", "village", "khata_number", "district")} == {"khasra_number": "213/1", "owner_name": "Ram Prasad", "village": "Rampur", "khata_number": "00620", "district": "Lucknow"}
    assert got["area"].status == "needs_review" and got["khasra_number"].confidence > 0.9


def test_learning(spark):
    c = spark.createDataFrame([("village", "Rampr", "Rampur")] * 4 + [("village", "Rampr", "Rampura")] + [("khata_number", "4474", "4471")] * 4, "field_key string, ai_value string, human_value string")
    (a,) = learning.aliases(c).collect()
    assert (a.corrected_value, a.support, a.agreement, a.auto_apply) == ("Rampur", 4, 0.8, True)
    assert [tuple(r) for r in learning.mined_confusions(c).collect()] == [("4", "1", 4, True)] or ("4", "1", 4, True) in [tuple(r) for r in learning.mined_confusions(c).collect()]
    v = spark.createDataFrame([("4474",)], "v string").select(learning.variants(F.col("v"), "4", "1").alias("x")).first().x
    assert set(v) == {"1474", "4174", "4471"}


def test_edits(spark):
    f = spark.createDataFrame([(1, "village", "A", "extracted"), (1, "area", "2", "extracted"), (1, "state", None, "missing")], "document_id long, field_key string, value string, status string")
    e = spark.createDataFrame([(1, "village", "B", False, 1), (1, "village", "C", False, 2), (1, "area", "9", True, 1), (1, "state", "", False, 1)], "document_id long, field_key string, new_value string, confirm_only boolean, seq int")
    got = {r.field_key: (r.value, r.status) for r in records.apply_edits(f, e).collect()}
    assert got == {"village": ("C", "corrected"), "area": ("2", "confirmed"), "state": ("", "confirmed")}


def test_registry_match(spark):
    reg = spark.createDataFrame([("R1", "213/1", "5", "Rampur", "Lucknow"), ("R2", "99", "7", "Sitapur", "Agra")], "source_id string, khasra_number string, khata_number string, village string, district string")
    rec = spark.createDataFrame([(1, "213/1", "5", "Rampr", "Lucknow"), (2, "99", "7", "Sitapur", "Agra")], "id long, khasra_number string, khata_number string, village string, district string")
    got = {r.id: r for r in registry.best_match(rec, reg).collect()}
    assert got[1].source_id == "R1" and 0.55 < got[1].score < 1 and got[2].score == pytest.approx(1.0)


def test_no_pair_joins_by_nested_loops(spark):
    p = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(40)], "parcel_id long, x0 double, y0 double").withColumn("x1", F.col("x0") + 1.2).withColumn("y1", F.col("y0") + 1.2)
    found = spatial.pairs(p, p, F.col("a.parcel_id") < F.col("b.parcel_id"), 1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == p.alias("a").crossJoin(p.alias("b")).where("a.parcel_id < b.parcel_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1").count()


def test_snapping_is_stable(spark):
    rows = [("m", 1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), ("m", 2, [(1.0001, 0.0), (2.0, 0.0), (1.0, 1.0001)])]
    df = spark.createDataFrame([(k, i, [{"x": x, "y": y} for x, y in r]) for k, i, r in rows], "k string, parcel_id long, ring array<struct<x:double,y:double>>")
    got = topology.snap(df, 0.01, "k").collect()
    assert {(r.sx, r.sy) for r in got if r.parcel_id == 2} == {(1.0, 0.0), (2.0, 0.0), (1.0, 1.0)}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 10:05:00", "a"), (3, "2024-01-03 09:00:00", "b")], "id long, at string, text string").withColumn("at", F.col("at").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    s = ingest.stream(spark, str(tmp_path / "in"), rows.schema)
    for name, df in (("firsts", ingest.first_copies(s, "at", "text")), ("volumes", ingest.volume(s, "at"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "firsts" else "complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    assert sorted(r.text for r in spark.table("firsts").collect()) == ["a", "b"]
    assert sorted(r.c for r in spark.table("volumes").collect()) == [1, 2]


def token(claims, secret="s", alg="HS256"):
    import base64
    import hashlib
    import hmac
    import json

    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    body = f"{enc({'alg': alg})}.{enc(claims)}"
    return f"{body}.{base64.urlsafe_b64encode(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest()).rstrip(b'=').decode()}"


def test_tokens():
    from plotwright.functions import auth

    claims = {"sub": "u1", "exp": 1000, "aud": "app", "email": " A@B.c ", "user_metadata": {"role": "admin"}}
    assert auth.verified_claims(token(claims), "s", "app", now=990) == claims
    assert auth.role_of(claims) == "admin" and auth.role_of(claims | {"app_metadata": {"role": "operator"}}) == "operator" and auth.role_of({}) == "auditor"
    assert auth.name_of(claims) == "a@b.c"
    for bad in (token(claims, "other"), token(claims, alg="none"), token({"sub": "u1"}), token(claims | {"exp": 1}), token(claims | {"nbf": 5000}), token(claims | {"sub": ""}), "a.b", ""):
        with pytest.raises(auth.Refused):
            auth.verified_claims(bad, "s", "app", now=990)
    with pytest.raises(auth.Refused, match="audience"):
        auth.verified_claims(token(claims), "s", "else", now=990)


def test_scans(spark):
    from plotwright.operators import scans

    words = spark.createDataFrame([(1, 50.0, 10.0, 80.0, 20.0, "213/1"), (1, 0.0, 11.0, 40.0, 21.0, "Khasra"), (1, 0.0, 40.0, 30.0, 50.0, "Next")], "page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r.text for r in scans.visual_rows(words, "page").orderBy("line_no").collect()] == ["Khasra 213/1", "Next"]
    masks = spark.createDataFrame([("m", 1, 0.0, 0.0, 10.0, 10.0), ("m", 2, 1.0, 1.0, 9.0, 9.0), ("m", 3, 8.0, 8.0, 18.0, 18.0)], "k string, mask_id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.mask_id for r in scans.drop_nested(masks, "k").collect()) == [1, 3]
    cut = spark.createDataFrame([("one two three four", 50.0, 10.0), ("indivisible", 10.0, 10.0), ("ok", 10.0, 10.0)], "t string, w double, h double")
    assert [r[0] for r in cut.select(scans.trim_overrun(F.col("t"), F.col("w"), F.col("h"))).collect()] == ["one", "indivisible", "ok"]
    assert spark.createDataFrame([("a12b3", ["7", "88"])], "t string, r array<string>").select(scans.with_digits(F.col("t"), F.col("r"))).first()[0] == "a7b88"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_rings_of_text_are_read_once(spark):
    df = spark.createDataFrame([("POLYGON((0 0,2 0,2 2,0 2,0 0))",), ("POLYGON((0 0,1 1))",), (None,)], "t string")
    r = geometry.from_wkt(F.col("t"))
    out = df.select(F.size(r).alias("n"), geometry.area(r).alias("area"))
    assert df.select(geometry.area(r).alias("area"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
    assert [tuple(x) for x in out.collect()][0] == (4, 4.0)


def test_objects_of_a_city_do_not_carry_all_its_vertices(spark):
    from plotwright.sources import readers

    objects = ",".join(f'"o{k}":{{"attributes":{{"n":"{k}"}},"geometry":[{{"boundaries":[[[{3 * k},{3 * k + 1},{3 * k + 2}]]]}}]}}' for k in range(50))
    vertices = ",".join(f"[{k},0,0],[{k + 1},0,0],[{k},2,0]" for k in range(50))
    df = readers.cityjson_parcels(spark.createDataFrame([(f'{{"type":"CityJSON","CityObjects":{{{objects}}},"vertices":[{vertices}]}}',)], "json string"), "json")
    assert "vs#" not in plan_of(df)
    got = {x.object_id: (x.ring[0].x, len(x.ring), x.surfaces) for x in df.collect()}
    assert got == {f"o{k}": (float(k), 3, 1) for k in range(50)}


def test_cells_are_not_sent_through_the_driver(spark):
    for name in ("topo_unsnapped", "topo_overlaps", "set_involves_stack"):
        assert "BroadcastExchange" not in plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")), name
    assert "BroadcastHashJoin [a#" not in plan_of(QUERIES["agg_topology_counts"](spark, "/root/testdata/sf0.001"))


def test_control_points_are_fitted_in_one_shuffle_without_joins(spark):
    plan = QUERIES["math_control_fit_robust"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_pairs_that_involve_a_volume(spark):
    v = spark.sql("SELECT id AS rn, concat('P-', id % 3) AS ulpin_3d, concat('P', id % 4) AS parcel_ulpin, 'G00' AS level_code, false AS footprint_is_parcel, 0D AS base_m, 3D AS top_m, CAST(id AS DOUBLE) / 2 AS x0, 0D AS y0, CAST(id AS DOUBLE) / 2 + 1.2 AS x1, 1D AS y1 FROM range(40)")
    some = sorted(tuple(x) for x in vertical.conflicts(v, 1.0, F.col("parcel_ulpin") == "P1").select("rule", "a", "b").collect())
    every = vertical.conflicts(v, 1.0).select("rule", "a", "b").collect()
    assert some == sorted(tuple(x) for x in every if x.a % 4 == 1 or x.b % 4 == 1) and 0 < len(some) < len(every)


@pytest.mark.parametrize(("mean", "warnings", "want"), [(0.4135, 2, 29.4), (0.34049999999999997, 1, 28.1), (0.5495, 0, 55.0), (0.6244999999999999, 0, 62.5), (0.1, 9, 0.0)])
def test_trust_is_rounded_as_its_sql_rounds(spark, mean, warnings, want):
    import duckdb

    got = spark.range(1).select(rules.trust(F.lit(mean), F.lit(0), F.lit(warnings)).alias("t")).first().t
    assert got == want == duckdb.execute(f"SELECT greatest(0.0::DOUBLE, round(({mean}::DOUBLE - least(0.6::DOUBLE, {warnings} * 0.06::DOUBLE)) * 100, 1))").fetchall()[0][0]
