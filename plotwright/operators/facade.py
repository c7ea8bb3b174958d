"""What a service over the tables asks for, each as one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import FIELD
from . import audit, records, stats

TRAIL, AUDIT_PAGE, CORRECTIONS = 60, 150, 40


class Records:
    """The record tables behind the questions that a review desk has."""

    def __init__(self, documents: DataFrame, fields: DataFrame, users: DataFrame, log: DataFrame, corrections: DataFrame):
        self.documents, self.fields, self.users, self.log, self.corrections = documents, fields, users, log, corrections

    def queue(self, status: str | None = None, search: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of records, newest first; the page is cut before anything is joined to it."""
        d = self.documents if status in (None, "all") else self.documents.where(F.col("status") == status)
        if search:
            d = records.search(d, self.fields, search)
        return records.listing(records.page(d, limit, offset), self.users, self.fields)

    def document(self, document_id: int) -> DataFrame:
        """One record with its fields and its last audit entries, in one row."""
        d = self.documents.where(F.col("id") == document_id)
        f = self.fields.where(F.col("document_id") == document_id).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("field_key", "value", "status"))).alias("fields"))
        t = audit.trail(self.log, document_id, TRAIL).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("id", "action")), asc=False).alias("trail"))
        return d.join(f.withColumnRenamed("document_id", "f_id"), F.col("id") == F.col("f_id"), "left").drop("f_id").join(t.withColumnRenamed("document_id", "t_id"), F.col("id") == F.col("t_id"), "left").drop("t_id")

    def stats(self) -> dict[str, DataFrame]:
        """The dashboard's tables by name."""
        return {
            "totals": stats.totals(self.documents, self.corrections, self.fields), "by_status": stats.by_status(self.documents), "pending": stats.pending(self.documents), "averages": stats.averages(self.documents),
            "by_district": stats.by_district(self.documents, self.fields), "by_engine": stats.by_engine(self.documents), "field_accuracy": stats.field_accuracy(self.fields), "precision": stats.overall_precision(self.corrections, self.fields),
        }

    def audit_page(self, limit: int = AUDIT_PAGE) -> DataFrame:
        return audit.trail(self.log, None, min(limit, records.PAGE_LIMIT))

    def recent_corrections(self) -> DataFrame:
        return self.corrections.orderBy(F.desc("id")).limit(CORRECTIONS)


def field_schema(spark) -> DataFrame:
    """The seventeen fields as a table."""
    return spark.createDataFrame([(f.key, f.kind, f.required, f.pattern) for f in FIELD.values()], "key string, kind string, required boolean, pattern string")


def with_rights(users: DataFrame, right: str) -> DataFrame:
    """Users whose role has a right."""
    return records.rights(users).where(F.array_contains(F.split("rights", ","), right))
