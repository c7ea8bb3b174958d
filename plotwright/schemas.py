"""Schemas of the seven record tables, and additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING = "array<struct<x:double,y:double>>"
ISSUE = "struct<rule:string,severity:string,field:string,message:string>"
#: Columns by table. JSON texts of a row store are nested columns here.
TABLES = {
    "users": "id long, username string, full_name string, role string, office string, created_at string",
    "documents": (
        "id long, filename string, stored_path string, preview_path string, sha256 string, file_size long, mime string, uploaded_by long, uploaded_at timestamp, ocr_engine string, page_count int, mean_ocr_conf double, "
        f"legibility double, quality map<string,string>, warnings array<string>, full_text string, status string, decision string, trust_score double, error_count int, warning_count int, signature string, issues array<{ISSUE}>, "
        "summary map<string,string>, geotag struct<name:string,level:string,lat:double,lon:double,accuracy_m:int>, owners array<string>, parcel_map string, verified_by long, verified_at timestamp, reject_reason string, processing_ms long"
    ),
    "fields": (
        "id long, document_id long, field_key string, display string, ai_value string, ai_confidence double, conf_label double, conf_pattern double, conf_ocr double, value string, status string, page int, "
        "bbox struct<x0:double,y0:double,x1:double,y1:double>, source_line string, notes array<string>, extra map<string,string>, corrected_by long, corrected_at timestamp"
    ),
    "audit_log": "id long, at string, user_id long, username string, role string, action string, document_id long, field_key string, old_value string, new_value string, detail string, prev_hash string, entry_hash string",
    "corrections": "id long, at timestamp, document_id long, field_key string, ai_value string, human_value string, ai_confidence double, ocr_engine string, source_line string",
    "vertical_parcel": f"id long, ulpin_3d string, parcel_ulpin string, level_code string, unit int, base_m double, top_m double, surveyed boolean, footprint_is_parcel boolean, building int, footprint {RING}, owner_name string, document_id long, created_at timestamp",
    "parcel_geometry": f"id long, map_id string, parcel_id long, khasra_number string, village string, district string, document_id long, is_demo boolean, ring {RING}",
}
#: Values that a column may take.
CHECKS = {
    ("users", "role"): ("operator", "verifier", "admin", "auditor"),
    ("documents", "status"): ("processing", "needs_review", "blocked", "auto_approved", "approved", "rejected"),
    ("fields", "status"): ("extracted", "missing", "needs_review", "confirmed", "corrected"),
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """`df` with the table's columns, in order: what it lacks is null, what the table does not know is dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows with a value that a checked column may not take, and the column's name; null is allowed."""
    bad = F.lit(None).cast("string")
    for (t, column), allowed in CHECKS.items():
        if t == table:
            bad = F.when(~F.col(column).isin(*allowed), column).otherwise(bad)
    return df.withColumn("bad_column", bad).where("bad_column IS NOT NULL")
