"""Dashboard aggregates over records, their fields and their issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING = ("needs_review", "blocked")
REVIEWED = ("corrected", "confirmed")


def count_where(condition: Column) -> Column:
    """How many rows meet the condition, 0 for none."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def by_status(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count("*").alias("c"))


def pending(documents: DataFrame) -> DataFrame:
    return documents.agg(count_where(F.col("status").isin(*PENDING)).alias("pending_verification"))


def averages(documents: DataFrame) -> DataFrame:
    """Mean trust, legibility and OCR confidence, rounded; mean processing time, cut to whole milliseconds."""
    return documents.agg(
        F.round(F.avg("trust_score"), 1).alias("avg_trust_score"),
        F.round(F.avg("legibility"), 1).alias("avg_legibility"),
        F.round(F.avg("mean_ocr_conf"), 4).alias("avg_ocr_confidence"),
        F.floor(F.avg("processing_ms")).cast("long").alias("avg_processing_ms"),
    )


def with_field(documents: DataFrame, fields: DataFrame, key: str, name: str) -> DataFrame:
    """Documents with the value of one field, null where it has none; the key is tested in the join."""
    f = fields.where(F.col("field_key") == key).select("document_id", F.col("value").alias(name))
    return documents.join(f, documents["id"] == f["document_id"], "left").drop("document_id")


def by_district(documents: DataFrame, fields: DataFrame, top: int = 12) -> DataFrame:
    """The districts with most records; ties go by name."""
    named = with_field(documents, fields, "district", "d").withColumn("district", F.coalesce("d", F.lit("Unassigned")))
    return named.groupBy("district").agg(F.count("*").alias("c"), F.round(F.avg("trust_score"), 1).alias("avg_trust")).orderBy(F.desc("c"), "district").limit(top)


def by_engine(documents: DataFrame) -> DataFrame:
    engine = F.coalesce("ocr_engine", F.lit("unknown")).alias("engine")
    return documents.groupBy(engine).agg(F.count("*").alias("c"), F.round(F.avg("trust_score"), 1).alias("avg_trust"))


def field_accuracy(fields: DataFrame) -> DataFrame:
    """Review outcome and precision of each field; precision is null where nothing was reviewed."""
    counted = fields.groupBy("field_key").agg(
        F.count("*").alias("total"),
        count_where(F.col("status") == "corrected").alias("corrected"),
        count_where(F.col("status") == "confirmed").alias("confirmed"),
        count_where(F.col("value").isNull()).alias("missing"),
        F.round(F.avg("ai_confidence"), 4).alias("avg_conf"),
    )
    reviewed = F.col("corrected") + F.col("confirmed")
    return counted.withColumn("reviewed", reviewed).withColumn("precision", F.when(reviewed > 0, F.round(1 - F.col("corrected") / reviewed, 4)))


def overall_precision(corrections: DataFrame, fields: DataFrame) -> DataFrame:
    """Corrections, reviewed fields, and one less their ratio."""
    c = corrections.select(F.lit(1).alias("c"), F.lit(0).alias("f"))
    f = fields.select(F.lit(0).alias("c"), F.when(F.col("status").isin(*REVIEWED), 1).otherwise(0).alias("f"))
    both = c.unionByName(f).agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in (("c", "corrections_total"), ("f", "fields_reviewed"))])
    return both.withColumn("extraction_precision", F.when(F.col("fields_reviewed") > 0, F.round(1 - F.col("corrections_total") / F.col("fields_reviewed"), 4)))


def issue_frequency(issues: DataFrame, top: int = 10) -> DataFrame:
    """The rules that fire most, with the severity that came first; ties go by rule."""
    first = F.min_by("severity", F.struct("id", "pos")).alias("severity")
    return issues.groupBy("rule").agg(F.count("*").alias("count"), first).orderBy(F.desc("count"), "rule").limit(top)


def daily_volume(rows: DataFrame, at: str, days: int = 14) -> DataFrame:
    """Rows a day on the last `days` days that have any."""
    return rows.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("c")).orderBy(F.desc("day")).limit(days)


def document_summary(fields: DataFrame, required: tuple[str, ...], low: float = 0.80) -> DataFrame:
    """Completeness, missing required fields, weak fields and mean confidence of each record."""
    present = F.col("value").isNotNull()
    listed = F.sort_array(F.collect_list(F.when(~present & F.col("field_key").isin(*required), F.col("field_key"))))
    weak = F.sort_array(F.collect_list(F.when(present & (F.col("ai_confidence") < low), F.col("field_key"))))
    g = fields.groupBy("document_id").agg(F.count("*").alias("fields_total"), count_where(present).alias("fields_extracted"), listed.alias("m"), weak.alias("w"), F.avg(F.when(present, F.col("ai_confidence"))).alias("a"))
    return g.select(
        "document_id", "fields_total", "fields_extracted",
        F.round(F.col("fields_extracted") / F.col("fields_total"), 4).alias("completeness"),
        F.array_join("m", ",").alias("required_missing"), F.array_join("w", ",").alias("low_confidence_fields"),
        F.coalesce(F.round("a", 4), F.lit(0.0)).alias("mean_field_confidence"),
    )


def totals(documents: DataFrame, corrections: DataFrame, fields: DataFrame) -> DataFrame:
    """Counts of records, corrections and reviewed fields, one row each."""
    return (
        documents.agg(F.count("*").alias("n")).select(F.lit("documents_total").alias("name"), "n")
        .unionByName(corrections.agg(F.count("*").alias("n")).select(F.lit("corrections_total").alias("name"), "n"))
        .unionByName(fields.agg(count_where(F.col("status").isin(*REVIEWED)).alias("n")).select(F.lit("fields_reviewed").alias("name"), "n"))
    )
