"""Schemas and the facade over the bindings."""

import pytest

from plotwright import schemas
from plotwright.operators.facade import Records, field_schema, with_rights
from plotwright.plans.bindings import frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def desk(spark):
    return Records(*[frame(spark, SF, n) for n in ("rec_documents", "rec_fields", "rec_users", "rec_audit", "rec_corrections")])


def test_schemas(spark):
    assert set(schemas.TABLES) == {"users", "documents", "fields", "audit_log", "corrections", "vertical_parcel", "parcel_geometry"}
    df = schemas.conform(spark.createDataFrame([(1, "x", 5)], "id long, role string, extra int"), "users")
    assert df.schema == schemas.schema("users") and df.first().username is None
    assert schemas.violations(df, "users").first().bad_column == "role"


def test_queue(desk):
    rows = desk.queue(limit=10, offset=5).collect()
    ids = sorted((r.id for r in rows), reverse=True)
    assert len(ids) == 10 and ids == list(range(ids[0], ids[0] - 10, -1))
    assert all(r.status == "approved" for r in desk.queue("approved", limit=5).collect())
    assert desk.queue(search="record-77.pdf").count() == 1 and desk.queue(limit=10_000).count() == 500


def test_document(desk):
    r = desk.document(7).first()
    assert r.id == 7 and len(r.fields) == 7 and [f.field_key for f in r.fields] == sorted(f.field_key for f in r.fields)
    assert r.trail and [t.id for t in r.trail] == sorted((t.id for t in r.trail), reverse=True)


def test_stats_and_rights(spark, desk):
    got = desk.stats()
    assert got["by_status"].groupBy().sum("c").first()[0] == desk.documents.count()
    assert got["by_district"].count() <= 12 and desk.recent_corrections().count() == 40
    assert field_schema(spark).where("required").count() == 6
    assert {r.role for r in with_rights(desk.users, "approve").collect()} == {"verifier", "admin"}
