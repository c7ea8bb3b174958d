"""What corrections teach: aliases, character confusions and calibration, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import confusions
from ..functions.text import compare_key
from ..functions.vocab import FIELD

# Support that a lesson needs, agreement, and the samples and bounds of calibration.
ALIAS_SUPPORT, CONFUSION_SUPPORT, AGREEMENT = 3, 4, 0.8
CALIBRATION_LEAST, CALIBRATION_FULL, DEFLATE, INFLATE = 8, 40.0, 0.5, 1.15
REVIEW = 0.90
TEXT_FIELDS = tuple(k for k, f in FIELD.items() if f.kind in ("text", "class"))
NUMBER_FIELDS = tuple(k for k, f in FIELD.items() if f.kind == "number")


def _real(corrections: DataFrame) -> DataFrame:
    return corrections.where("ai_value <> '' AND human_value <> '' AND ai_value <> human_value")


def aliases(corrections: DataFrame) -> DataFrame:
    """For each wrong value the correction most often made, with support and agreement; ties go to the lesser value."""
    c = _real(corrections).where(F.col("field_key").isin(*TEXT_FIELDS)).withColumn("akey", compare_key(F.col("ai_value")))
    votes = c.groupBy("field_key", "akey", "human_value").agg(F.count("*").alias("n"))
    won = votes.groupBy("field_key", "akey").agg(F.min_by(F.struct("human_value", "n"), F.struct(-F.col("n"), F.col("human_value"))).alias("w"), F.sum("n").alias("total"))
    share = F.round(F.col("w.n") / F.col("total"), 3)
    return won.where(F.col("w.n") >= ALIAS_SUPPORT).select("field_key", "akey", F.col("w.human_value").alias("corrected_value"), F.col("w.n").alias("support"), share.alias("agreement"), (F.col("w.n") / F.col("total") >= AGREEMENT).alias("auto_apply"))


def mined_confusions(corrections: DataFrame) -> DataFrame:
    """Character pairs that corrections replace; safe to apply alone only in numbers and towards a digit."""
    pair = _real(corrections).select("field_key", F.explode(confusions(F.col("ai_value"), F.col("human_value"))).alias("p"))
    p = pair.select("field_key", F.substr("p", F.lit(1), F.lit(1)).alias("from_char"), F.substr("p", F.lit(2), F.lit(1)).alias("to_char"))
    number = F.max(F.col("field_key").isin(*NUMBER_FIELDS))
    g = p.groupBy("from_char", "to_char").agg(F.count("*").alias("support"), number.alias("in_numbers"))
    return g.where(F.col("support") >= CONFUSION_SUPPORT).select("from_char", "to_char", "support", (F.col("in_numbers") & F.col("to_char").rlike("^[0-9]$")).alias("auto_apply"))


def calibration(accuracy: DataFrame) -> DataFrame:
    """A multiplier per field that moves stated confidence towards observed precision, weaker on few reviews."""
    ratio = F.col("precision") / F.col("avg_conf")
    weight = F.least(F.lit(1.0), F.col("reviewed") / CALIBRATION_FULL)
    m = F.greatest(F.lit(DEFLATE), F.least(F.lit(INFLATE), (ratio - 1) * weight + 1))
    a = accuracy.where((F.col("reviewed") >= CALIBRATION_LEAST) & F.col("precision").isNotNull() & (F.col("avg_conf") > 0))
    return a.select("field_key", "reviewed", F.round(m, 4).alias("multiplier"), F.when(m < 0.98, "deflate").when(m > 1.02, "inflate").otherwise("stable").alias("direction"))


def variants(value: Column, wrong: str, right: str) -> Column:
    """Every value that one replacement of a character gives."""
    n = F.length(value)
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(value, i, F.lit(1)) == wrong)
    return F.transform(places, lambda i: F.concat(F.substr(value, F.lit(1), i - 1), F.lit(right), F.substr(value, i + 1, n)))


def apply_aliases(fields: DataFrame, learned: DataFrame) -> DataFrame:
    """Fields with learned values in place of known wrong ones."""
    a = learned.where("auto_apply").select("field_key", "akey", "corrected_value")
    j = fields.withColumn("akey", compare_key(F.col("value"))).join(a, ["field_key", "akey"], "left")
    changed = F.col("corrected_value").isNotNull() & (F.col("corrected_value") != F.col("value"))
    return j.withColumn("learned", F.coalesce(changed, F.lit(False))).withColumn("value", F.when(changed, F.col("corrected_value")).otherwise(F.col("value"))).drop("akey", "corrected_value")


def apply_calibration(fields: DataFrame, learned: DataFrame) -> DataFrame:
    """Fields with recalibrated confidence, and their status set by the review threshold."""
    j = fields.join(learned.select("field_key", "multiplier"), "field_key", "left")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ai_confidence") * F.coalesce("multiplier", F.lit(1.0))))
    status = F.when(F.col("status").isin("missing", "needs_review"), F.col("status")).when(conf < REVIEW, "needs_review").otherwise("extracted")
    return j.withColumn("new_confidence", F.round(conf, 7)).withColumn("new_status", status).drop("multiplier")


def repair(fields: DataFrame, known: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Plot numbers that no authority knows, with the one variant that it does know.

    `known` has village and khasra_number. Several known variants are ambiguous and change nothing.
    """
    k = known.select("village", F.col("khasra_number").alias("variant")).distinct().withColumn("vouched", F.lit(True))
    each = F.array_distinct(F.flatten(F.array(*[variants(F.col("value"), a, b) for a, b in rules])))
    self = F.array(F.col("value"))
    v = fields.withColumn("variant", F.explode(F.array_distinct(F.concat(self, each))))
    j = v.join(k, ["village", "variant"], "left")
    own = F.max(F.when((F.col("variant") == F.col("value")) & F.col("vouched"), 1).otherwise(0))
    hits = F.array_sort(F.collect_set(F.when((F.col("variant") != F.col("value")) & F.col("vouched"), F.col("variant"))))
    g = j.groupBy("id", "village", "value").agg(own.alias("own"), hits.alias("hits"))
    outcome = F.when(F.col("own") == 1, "vouched").when(F.size("hits") == 1, "repaired").when(F.size("hits") > 1, "ambiguous").otherwise("unknown")
    return g.select("id", "village", "value", outcome.alias("outcome"), F.when(outcome == "repaired", F.get("hits", 0)).otherwise(F.col("value")).alias("new_value"))
