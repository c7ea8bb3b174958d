"""The rule engine: each rule turns a record's columns into an array of issues.

A record is a row with a string column per field key (null or empty: missing). Rules never fail a
job: what cannot be read becomes an issue. `validate` runs them in order and decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lets import let
from ..functions.parse import parse_area
from ..functions.text import compare_key, looks_like_placeholder, normalise
from ..functions.vocab import FIELD, IDENTIFIERS, LAND_CLASSES, PLACEHOLDERS, REQUIRED

ISSUE = "array<struct<rule:string,severity:string,field:string,message:string>>"
# Bounds of plausible parcel areas in square metres, and the thresholds of confidence.
AREA_HARD_MIN, AREA_MIN, AREA_MAX, AREA_HARD_MAX = 0.5, 5.0, 4_000_000.0, 40_000_000.0
LOW_CONFIDENCE, VERY_LOW_CONFIDENCE = 0.80, 0.55
OLDEST_YEAR = 1850
PATTERNED = ("khasra_number", "khata_number", "survey_number", "mutation_number", "registration_number", "ulpin")
NAMED = ("owner_name", "father_name", "village", "tehsil", "district", "state", "land_classification")
#: What a document type demands where it is not the whole schema.
DEMANDED = {
    "plot_report": ("khasra_number", "area"), "power_of_attorney": ("owner_name", "village"), "sale_deed": ("owner_name", "village", "area"),
    "mutation_order": ("owner_name", "village", "khasra_number"), "stamp_certificate": ("owner_name",),
}


def got(key: str) -> Column:
    """The field's value, null if it is missing or empty."""
    return F.nullif(F.col(key), F.lit(""))


def issue(rule: str, severity: str | Column, field: str | None, message: str | Column) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    grade = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(F.lit(rule).alias("rule"), grade.alias("severity"), F.lit(field).cast("string").alias("field"), text.alias("message"))


def found(*cases: tuple[Column, Column]) -> Column:
    """The issues whose condition holds, in order; an unknown condition does not hold."""
    each = F.array(*[F.when(F.coalesce(c, F.lit(False)), i) for c, i in cases])
    return F.filter(each, lambda x: x.isNotNull()).cast(ISSUE)


def demands(doc_type: str | Column | None, keys: tuple[str, ...]) -> Column:
    """Whether a document type demands one of the keys; a type that is not listed demands the whole schema."""
    if not isinstance(doc_type, Column):
        return F.lit(any(k in DEMANDED.get(doc_type or "", REQUIRED) for k in keys))
    out = F.lit(any(k in REQUIRED for k in keys))
    for name, needed in DEMANDED.items():
        out = F.when(doc_type == name, any(k in needed for k in keys)).otherwise(out)
    return out


def required_fields(doc_type: str | Column | None = None) -> Column:
    """`doc_type` is one type for all rows or a column."""
    cases = [(got(k).isNull() & demands(doc_type, (k,)), issue("REQUIRED_MISSING", "error", k, f"{k} is required and has no value")) for k in REQUIRED if k not in IDENTIFIERS]
    neither = F.lit(True)
    for k in IDENTIFIERS:
        neither = neither & got(k).isNull()
    cases.append((neither & demands(doc_type, IDENTIFIERS), issue("REQUIRED_MISSING", "error", IDENTIFIERS[0], "no parcel identifier: one of " + " or ".join(IDENTIFIERS))))
    return found(*cases)


def area_sanity() -> Column:
    return let(parse_area(F.col("area")), _area_issues)


def _area_issues(a: Column) -> Column:
    raw, sqm = got("area"), a["sqm"]
    have = raw.isNotNull() & ~a["unit_missing"]
    return found(
        (raw.isNotNull() & a.isNull(), issue("AREA_UNPARSED", "error", "area", "the area has no number")),
        (raw.isNotNull() & a["unit_missing"], issue("AREA_UNIT_MISSING", "error", "area", "the area has no unit")),
        (have & (sqm <= 0), issue("AREA_NON_POSITIVE", "error", "area", "the area is not positive")),
        (have & (sqm > 0) & (sqm < AREA_HARD_MIN), issue("AREA_RANGE", "error", "area", "below any parcel")),
        (have & (sqm >= AREA_HARD_MIN) & (sqm < AREA_MIN), issue("AREA_RANGE", "warning", "area", "very small")),
        (have & (sqm > AREA_HARD_MAX), issue("AREA_RANGE", "error", "area", "above any parcel")),
        (have & (sqm > AREA_MAX) & (sqm <= AREA_HARD_MAX), issue("AREA_RANGE", "warning", "area", "very large")),
        (have & a["regional_unit"], issue("AREA_REGIONAL_UNIT", "info", "area", "the unit varies by region")),
    )


def identifier_formats() -> Column:
    cases = []
    for k in PATTERNED:
        cases.append((~got(k).rlike(FIELD[k].pattern), issue("FORMAT_INVALID", "warning", k, f"{k} has not the usual form")))
        cases.append((F.regexp_replace(got(k), r"\D", "").rlike("^0+$"), issue("IDENTIFIER_ZERO", "error", k, f"{k} is all zeros")))
    return found(*cases)


def _date(key: str) -> Column:
    """A strict ISO date, null otherwise."""
    return F.when(got(key).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(got(key), "yyyy-MM-dd"))


def dates(today: str) -> Column:
    now, cases = F.lit(today).cast("date"), []
    for k in ("registration_date", "mutation_date"):
        cases.append((got(k).isNotNull() & _date(k).isNull(), issue("DATE_UNPARSED", "warning", k, f"{k} is no date")))
        cases.append((_date(k) > now, issue("DATE_FUTURE", "error", k, f"{k} lies in the future")))
        cases.append(((_date(k) <= now) & (F.year(_date(k)) < OLDEST_YEAR), issue("DATE_TOO_OLD", "warning", k, f"{k} is older than land records")))
    cases.append((_date("mutation_date") < _date("registration_date"), issue("DATE_ORDER", "error", "mutation_date", "mutation before registration")))
    return found(*cases)


def land_classification() -> Column:
    return found((~got("land_classification").isin(*LAND_CLASSES), issue("CLASS_UNMAPPED", "warning", "land_classification", "not in the vocabulary")))


def ownership() -> Column:
    share, frac, pct = got("share"), r"^(\d{1,4})\s*/\s*(\d{1,4})$", r"^(\d{1,3}(?:\.\d+)?)\s*%$"
    num, den = F.regexp_extract(share, frac, 1).try_cast("int"), F.regexp_extract(share, frac, 2).try_cast("int")
    part = F.regexp_extract(share, pct, 1).try_cast("double")
    same = F.lower(normalise(got("owner_name"))) == F.lower(normalise(got("father_name")))
    return found(
        (same, issue("OWNER_FATHER_SAME", "warning", "father_name", "owner and father are the same")),
        (den == 0, issue("SHARE_INVALID", "error", "share", "the denominator is zero")),
        ((den > 0) & (num > den), issue("SHARE_OVER_UNITY", "error", "share", "more than the whole")),
        (part <= 0, issue("SHARE_INVALID", "error", "share", "no positive share")),
        (part > 100, issue("SHARE_OVER_UNITY", "error", "share", "more than the whole")),
    )


def linked_records() -> Column:
    cases = []
    for kind in ("mutation", "registration"):
        number, date = got(f"{kind}_number"), got(f"{kind}_date")
        cases.append((number.isNotNull() & date.isNull(), issue(f"{kind.upper()}_DATE_MISSING", "warning", f"{kind}_date", "a number without a date")))
        cases.append((date.isNotNull() & number.isNull(), issue(f"{kind.upper()}_NUMBER_MISSING", "warning", f"{kind}_number", "a date without a number")))
    return found(*cases)


def placeholders() -> Column:
    return found(*[(looks_like_placeholder(got(k), PLACEHOLDERS), issue("PLACEHOLDER_VALUE", "error" if FIELD[k].required else "warning", k, f"{k} stands for no value")) for k in NAMED])


def low_confidence(confidence: Callable[[str], Column], threshold: float = LOW_CONFIDENCE, doc_type: str | Column | None = None) -> Column:
    """Fields that are there but read with low confidence; `confidence` gives the column for a key."""
    cases = []
    for k in FIELD:
        c = F.coalesce(confidence(k), F.lit(0.0))
        grade = F.when((c < VERY_LOW_CONFIDENCE) & demands(doc_type, (k,)), "error").otherwise("warning")
        cases.append((F.col(k).isNotNull() & (c < threshold), issue("LOW_CONFIDENCE", grade, k, f"{k} was read with low confidence")))
    return found(*cases)


def hierarchy(records: DataFrame, admin: DataFrame) -> DataFrame:
    """Records with `hierarchy_issues`: district, state, tehsil and village against the administrative master.

    All lookups are equi-joins on comparison keys, scoped by district; the master's sides are small
    aggregates, left to the engine to broadcast or not.
    """
    key = lambda c: compare_key(F.coalesce(F.col(c), F.lit("")))
    m = admin.select(*[F.col(c) for c in ("state", "district", "tehsil", "village")], key("district").alias("dk"), key("tehsil").alias("tk"), key("village").alias("vk"))
    d = m.groupBy("dk").agg(F.max("state").alias("m_state"))
    t = m.where("tk <> ''").groupBy("dk").agg(F.collect_set("tk").alias("m_tehsils"))
    v = m.where("vk <> ''").groupBy("dk", "vk").agg(F.collect_set("tk").alias("v_tehsils"))
    r = records.withColumn("dk", key("district")).withColumn("tk", key("tehsil")).withColumn("vk", key("village"))
    j = r.join(d, "dk", "left").join(t, "dk", "left").join(v, ["dk", "vk"], "left")
    district, known = got("district"), F.col("m_state").isNotNull()
    tehsil_ok = F.array_contains("m_tehsils", F.col("tk"))
    issues = found(
        (district.isNotNull() & ~known, issue("DISTRICT_UNKNOWN", "warning", "district", "not in the master")),
        (district.isNotNull() & known & got("state").isNotNull() & (key("state") != compare_key(F.col("m_state"))), issue("STATE_MISMATCH", "error", "state", "the district lies in another state")),
        (district.isNotNull() & known & got("state").isNull(), issue("STATE_INFERRED", "info", "state", "taken from the district")),
        (district.isNotNull() & known & got("tehsil").isNotNull() & ~tehsil_ok, issue("TEHSIL_MISMATCH", "warning", "tehsil", "not in the district")),
        (district.isNotNull() & known & got("tehsil").isNotNull() & tehsil_ok & got("village").isNotNull() & F.col("v_tehsils").isNotNull() & ~F.array_contains("v_tehsils", F.col("tk")), issue("VILLAGE_TEHSIL_MISMATCH", "warning", "village", "in another tehsil")),
    )
    return j.withColumn("hierarchy_issues", issues).drop("dk", "tk", "vk", "m_tehsils", "v_tehsils", "m_state")


def parcel_signature() -> Column:
    """The parcel's key: khasra, village and district; null without the first two."""
    have = got("khasra_number").isNotNull() & got("village").isNotNull()
    return F.when(have, F.concat_ws("|", compare_key(got("khasra_number")), compare_key(got("village")), F.coalesce(compare_key(got("district")), F.lit(""))))


def duplicates(records: DataFrame, id_col: str = "id") -> DataFrame:
    """One issue per earlier record of the same parcel: a conflict if both name an owner and they differ."""
    s = records.select(F.col(id_col).alias("id"), parcel_signature().alias("signature"), F.lower(normalise(F.coalesce(got("owner_name"), F.lit("")))).alias("owner")).where("signature IS NOT NULL")
    e = s.select(F.col("id").alias("earlier_id"), "signature", F.col("owner").alias("earlier_owner"))
    j = s.join(e, "signature").where("earlier_id < id")
    conflict = (F.col("owner") != "") & (F.col("earlier_owner") != "") & (F.col("owner") != F.col("earlier_owner"))
    return j.select("id", "earlier_id", F.when(conflict, "DUPLICATE_CONFLICT").otherwise("DUPLICATE").alias("rule"), F.when(conflict, "error").otherwise("warning").alias("severity"))


#: Rules over the record alone, in the order they run. Add a name and a function to extend the engine.
RULES: dict[str, Callable[..., Column]] = {
    "required": required_fields, "area": area_sanity, "formats": identifier_formats, "dates": dates, "classification": land_classification,
    "ownership": ownership, "linked": linked_records, "placeholders": placeholders,
}


def decision(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "blocked").when(warnings > 0, "needs_review").otherwise("auto_approved")


def trust(mean_confidence: Column, errors: Column, warnings: Column) -> Column:
    """Mean confidence less a penalty for issues, as points from 0 to 100."""
    penalty = F.least(F.lit(0.6), errors * 0.18 + warnings * 0.06)
    # to tenths on the binary value, as the SQL rounds: halves of the decimal form differ where ten times the value is a half
    return F.greatest(F.lit(0.0), F.round((mean_confidence - penalty) * 100 * 10) / 10)


def validate(records: DataFrame, confidence: Callable[[str], Column], today: str, admin: DataFrame | None = None, doc_type: str | Column | None = None) -> DataFrame:
    """Records with issues, their counts, decision, trust score and signature.

    One narrow pass, but for the joins to the master. Without a master the lack is itself an issue.
    """
    r = hierarchy(records, admin) if admin is not None else records.withColumn("hierarchy_issues", found((F.lit(True), issue("MASTER_UNAVAILABLE", "info", None, "no administrative master"))))
    call = {"required": lambda f: f(doc_type), "dates": lambda f: f(today)}

    def ran(name: str, rule: Callable[..., Column]) -> Column:
        """A rule that cannot run on these columns is an issue, not a failure."""
        try:
            out = call.get(name, lambda f: f())(rule)
            r.select(out).schema  # noqa: B018  asks the analyser
            return out
        except AnalysisException as why:
            return found((F.lit(True), issue("RULE_ERROR", "warning", None, f"{name}: {why.getCondition()}")))

    parts = [ran(n, f) for n, f in RULES.items()]
    parts.insert(4, F.col("hierarchy_issues"))
    r = r.withColumn("issues", F.concat(*parts, low_confidence(confidence, doc_type=doc_type)))
    for name, grade in (("error_count", "error"), ("warning_count", "warning"), ("info_count", "info")):
        r = r.withColumn(name, F.size(F.filter("issues", _graded(grade))))
    present = [F.when(F.col(k).isNotNull(), F.coalesce(confidence(k), F.lit(0.0))) for k in FIELD]
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in present), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in present), F.lit(0.0))
    mean = F.when(n > 0, total / n).otherwise(0.0)
    e, w = F.col("error_count"), F.col("warning_count")
    return r.withColumn("decision", decision(e, w)).withColumn("trust_score", trust(mean, e, w)).withColumn("signature", parcel_signature()).drop("hierarchy_issues")


def _graded(grade: str) -> Callable[[Column], Column]:
    return lambda x: x["severity"] == grade


#: Enrichers that count as warnings and demote an automatic approval; others only inform.
DEMOTING = ("FILE_ALREADY_UPLOADED", "MAP_KHASRA_MISMATCH", "SEAL_MISSING", "SIGNATURE_MISSING", "GEO_PLACE_CONFLICT", "GEO_AREA_MISMATCH", "ANOMALY_DETECTED")


def enrich(validated: DataFrame, extra: str) -> DataFrame:
    """Add the issues in column `extra`; demoting ones raise the warnings and turn auto_approved to needs_review. Trust stays."""
    more = F.size(F.filter(extra, lambda x: x["rule"].isin(*DEMOTING) & (x["severity"] == "warning")))
    return (
        validated.withColumn("issues", F.concat("issues", extra))
        .withColumn("warning_count", F.col("warning_count") + more)
        .withColumn("decision", F.when((F.col("decision") == "auto_approved") & (more > 0), "needs_review").otherwise(F.col("decision")))
        .drop(extra)
    )


def map_cross_check(khasra: Column, labels: Column, subject: Column, least_labels: int = 3) -> Column:
    """Issues from a plot map: its subject or one of its labels is the khasra, or it shows others only."""
    have = F.nullif(khasra, F.lit("")).isNotNull()
    return found(
        (have & (subject == khasra), issue("MAP_CONFIRMS_KHASRA", "info", "khasra_number", "the map's subject")),
        (have & ~(F.coalesce(subject, F.lit("")) == khasra) & F.array_contains(labels, khasra), issue("MAP_SHOWS_KHASRA", "info", "khasra_number", "on the map")),
        (have & ~(F.coalesce(subject, F.lit("")) == khasra) & ~F.array_contains(labels, khasra) & (F.size(labels) >= least_labels), issue("MAP_KHASRA_MISMATCH", "warning", "khasra_number", "not on the map")),
    )


def geo_area(sqm: Column, mapped_sqm: Column, tolerance: float = 0.15) -> Column:
    """Issues from comparing the recorded area with the mapped one."""
    off = F.abs(sqm - mapped_sqm) / mapped_sqm
    return found(
        (mapped_sqm.isNotNull(), issue("GEO_TAGGED", "info", None, "linked to a parcel")),
        (off > tolerance, issue("GEO_AREA_MISMATCH", "warning", "area", "the map has another area")),
        (off <= tolerance, issue("GEO_AREA_VERIFIED", "info", "area", "the map has this area")),
    )
