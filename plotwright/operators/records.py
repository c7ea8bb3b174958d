"""Reading and reviewing records: the queue, its search, single records, and the review states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that the queue shows.
SHOWN = ("owner_name", "village", "district", "khasra_number", "land_classification", "area")
PAGE_LIMIT = 500
#: Roles and what they may do; fixed values.
RIGHTS = {"operator": ("upload", "correct"), "verifier": ("upload", "correct", "approve", "reject", "revalidate"), "admin": ("upload", "correct", "approve", "reject", "revalidate", "retrain", "export", "purge"), "auditor": ()}


def wide(fields: DataFrame, keys: tuple[str, ...] = SHOWN) -> DataFrame:
    """One row per record with a column per field key, in one pass over the fields."""
    return fields.groupBy("document_id").agg(*[F.max(F.when(F.col("field_key") == k, F.col("value"))).alias(k) for k in keys])


def detail(documents: DataFrame, users: DataFrame) -> DataFrame:
    """Records with the names of who uploaded and who reviewed them: the same table twice."""
    name = lambda who: users.select(F.col("id").alias(f"{who}_id"), F.col("full_name").alias(f"{who}_name"))
    up, rev = name("uploader"), name("reviewer")
    j = documents.join(up, documents["uploaded_by"] == up["uploader_id"], "left").join(rev, documents["reviewed_by"] == rev["reviewer_id"], "left")
    return j.drop("uploader_id", "reviewer_id")


def ensure_users(users: DataFrame, asked: DataFrame) -> DataFrame:
    """Users and those asked for (username, full_name, role, office) that there are none of yet; known ones stay as they are."""
    new = asked.dropDuplicates(["username"]).join(users.select("username"), "username", "left_anti")
    return users.select("username", "full_name", "role", "office").unionByName(new.select("username", "full_name", "role", "office"))


def listing(documents: DataFrame, users: DataFrame, fields: DataFrame) -> DataFrame:
    """Records with the uploader's name and the shown fields."""
    u = users.select(F.col("id").alias("user_id"), F.col("full_name").alias("uploader_name"))
    d = documents.join(u, documents["uploaded_by"] == u["user_id"], "left").drop("user_id")
    w = wide(fields)
    return d.join(w, d["id"] == w["document_id"], "left").drop("document_id")


def page(documents: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the queue, newest first."""
    return documents.orderBy(F.desc("id")).offset(offset).limit(min(limit, PAGE_LIMIT))


def search(documents: DataFrame, fields: DataFrame, text: str, status: str | None = None) -> DataFrame:
    """Records whose file name, full text (if there is one) or any field value contains the text, any case; % and _ are wildcards, as in LIKE."""
    like = f"%{text}%"
    named = documents if status in (None, "all") else documents.where(F.col("status") == status)
    hits = fields.where(F.col("value").ilike(like)).select(F.col("document_id").alias("hit")).distinct()
    j = named.join(hits, named["id"] == hits["hit"], "left")
    said = F.col("full_text").ilike(like) if "full_text" in documents.columns else F.lit(False)
    return j.where(F.col("filename").ilike(like) | F.col("hit").isNotNull() | F.coalesce(said, F.lit(False))).drop("hit")


def with_corrector(fields: DataFrame, users: DataFrame) -> DataFrame:
    """Fields with the name and role of whoever corrected them."""
    u = users.select(F.col("id").alias("user_id"), F.col("full_name").alias("corrector"), F.col("role").alias("corrector_role"))
    return fields.join(u, fields["corrected_by"] == u["user_id"], "left").drop("user_id")


def other_signatures(documents: DataFrame) -> DataFrame:
    """Pairs of a record and each earlier record of the same parcel signature."""
    a = documents.where("signature IS NOT NULL").select(F.col("id").alias("document_id"), "signature")
    b = a.select(F.col("document_id").alias("earlier_id"), "signature")
    return a.join(b, "signature").where("earlier_id < document_id")


def values_map(fields: DataFrame) -> DataFrame:
    """Per record a map of field key to value and confidence; reviewed values count as certain."""
    conf = F.when(F.col("status").isin("confirmed", "corrected"), 1.0).otherwise(F.coalesce("ai_confidence", F.lit(0.0)))
    entry = F.struct("field_key", F.struct("value", conf.alias("confidence")).alias("v"))
    return fields.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("values"))


def reviewed_status(old: Column, new: Column, confirm_only: Column) -> Column:
    """confirmed if nothing changes, else corrected; null and the empty string are the same value."""
    return F.when(confirm_only | (F.coalesce(old, F.lit("")) == F.coalesce(new, F.lit(""))), "confirmed").otherwise("corrected")


def apply_edits(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Fields after the last edit of each (document_id, field_key); edits have new_value, confirm_only and seq."""
    last = edits.groupBy("document_id", "field_key").agg(F.max_by(F.struct("new_value", "confirm_only"), "seq").alias("e"))
    j = fields.join(last, ["document_id", "field_key"], "left")
    edited = F.col("e").isNotNull()
    status = F.when(edited, reviewed_status(F.col("value"), F.col("e.new_value"), F.col("e.confirm_only"))).otherwise(F.col("status"))
    value = F.when(edited & ~F.col("e.confirm_only"), F.col("e.new_value")).otherwise(F.col("value"))
    return j.select("document_id", "field_key", F.col("value").alias("old_value"), value.alias("value"), status.alias("status"), edited.alias("edited"))


def corrections_of(edited: DataFrame) -> DataFrame:
    """The correction rows that edits give rise to."""
    return edited.where("edited AND status = 'corrected'").select("document_id", "field_key", F.col("old_value").alias("ai_value"), F.col("value").alias("human_value"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest version of each key: an upsert read back."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def decide(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approvals and rejections: approval is refused while errors stand, a rejection needs a reason of 4 characters."""
    j = documents.join(decisions, documents["id"] == decisions["document_id"], "left").drop("document_id")
    approve = F.col("decision_asked") == "approve"
    reject = (F.col("decision_asked") == "reject") & (F.length(F.trim("reason")) >= 4)
    outcome = F.when(approve & (F.col("error_count") > 0), "refused").when(approve, "approved").when(reject, "rejected").when(F.col("decision_asked") == "reject", "refused")
    new = F.when(outcome.isin("approved", "rejected"), outcome).otherwise(F.col("status"))
    return j.withColumn("outcome", outcome).withColumn("new_status", new)


def rights(users: DataFrame) -> DataFrame:
    """Users with what their role may do."""
    table = F.create_map(*[x for r, v in RIGHTS.items() for x in (F.lit(r), F.lit(",".join(v)))])
    return users.select("id", "role", table[F.col("role")].alias("rights"))
