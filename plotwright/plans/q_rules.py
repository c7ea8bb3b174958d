"""Queries of the rule engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import parse_area
from ..functions.vocab import FIELD, LAND_CLASSES, PLACEHOLDERS, REQUIRED
from ..operators import doctype, registry, rules, stats
from .bindings import TODAY, base, ctes, frame
from .registry import query

VALUES = "rec_values"
KEYS = list(FIELD)


def listed(issues: DataFrame) -> DataFrame:
    """id, rule, severity and field of every issue."""
    return issues.select("id", F.explode("i").alias("x")).select("id", "x.rule", "x.severity", "x.field")


def _of(spark, sf, column) -> DataFrame:
    return listed(frame(spark, sf, VALUES).select("id", column.alias("i")))


def _g(key: str) -> str:
    return f"nullif({key}, '')"


def _union(*cases: tuple[str, str, str | None, str]) -> str:
    return " UNION ALL ".join(f"SELECT id, '{rule}' AS rule, '{sev}' AS severity, " + (f"'{field}'" if field else "NULL::VARCHAR") + f" AS field FROM rec_values WHERE {cond}" for rule, sev, field, cond in cases)


REQUIRED_SQL = _union(*[("REQUIRED_MISSING", "error", k, f"{_g(k)} IS NULL") for k in REQUIRED if k != "khasra_number"], ("REQUIRED_MISSING", "error", "khasra_number", f"{_g('khasra_number')} IS NULL AND {_g('survey_number')} IS NULL"))


@query(ctes(VALUES) + REQUIRED_SQL)
def rule_required(spark, sf):
    return _of(spark, sf, rules.required_fields())


#: Square metres of the areas that the binding writes.
AREAS = "(VALUES ('0.4820 hectare', 4820.0, false), ('2 bigha 10 biswa', 6322.98, true), ('57 SQ.YDS.', 47.659, false), ('3 sqm', 3.0, false), ('0.3 sq.m', 0.3, false), ('500 hectare', 5000000.0, false), ('5000 ha', 50000000.0, false), ('0 acre', 0.0, false), ('1,250 sq.m', 1250.0, false)) a(raw, sqm, regional)"


def _area(rule: str, sev: str, cond: str) -> str:
    return f"SELECT id, '{rule}' AS rule, '{sev}' AS severity, 'area' AS field FROM rec_values JOIN {AREAS} ON area = raw WHERE {cond}"


AREA_SQL = " UNION ALL ".join([
    _union(("AREA_UNPARSED", "error", "area", "area = 'blah'"), ("AREA_UNIT_MISSING", "error", "area", "area = '12'")),
    _area("AREA_NON_POSITIVE", "error", "sqm <= 0"), _area("AREA_RANGE", "error", "sqm > 0 AND sqm < 0.5"), _area("AREA_RANGE", "warning", "sqm >= 0.5 AND sqm < 5"),
    _area("AREA_RANGE", "error", "sqm > 40000000"), _area("AREA_RANGE", "warning", "sqm > 4000000 AND sqm <= 40000000"), _area("AREA_REGIONAL_UNIT", "info", "regional"),
])


@query(ctes(VALUES) + AREA_SQL)
def rule_area(spark, sf):
    return _of(spark, sf, rules.area_sanity())


@query(ctes(VALUES) + f"SELECT id, area, sqm::DOUBLE AS sqm, regional AS regional_unit, false AS unit_missing FROM rec_values JOIN {AREAS} ON area = raw UNION ALL SELECT id, area, NULL, false, true FROM rec_values WHERE area = '12'")
def math_area_sqm(spark, sf):
    a = parse_area(F.col("area"))
    return frame(spark, sf, VALUES).select("id", "area", a.alias("a")).where("a IS NOT NULL").select("id", "area", "a.sqm", "a.regional_unit", "a.unit_missing")


def _re(pattern: str) -> str:
    return pattern.replace("(?:क|ख|ग|अ|ब|[a-zA-Z])", "(?:[a-zA-Z])")


FORMATS_SQL = _union(*[c for k in rules.PATTERNED for c in (("FORMAT_INVALID", "warning", k, f"NOT regexp_matches({_g(k)}, '{_re(FIELD[k].pattern)}')"), ("IDENTIFIER_ZERO", "error", k, f"regexp_matches(regexp_replace({_g(k)}, '[^0-9]', '', 'g'), '^0+$')"))])


@query(ctes(VALUES) + FORMATS_SQL)
def rule_formats(spark, sf):
    return _of(spark, sf, rules.identifier_formats())


def _d(k: str) -> str:
    return f"CASE WHEN regexp_matches({k}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast({k} AS DATE) END"


DATES_SQL = _union(
    *[c for k in ("registration_date", "mutation_date") for c in (("DATE_UNPARSED", "warning", k, f"{_g(k)} IS NOT NULL AND {_d(k)} IS NULL"), ("DATE_FUTURE", "error", k, f"{_d(k)} > DATE '{TODAY}'"), ("DATE_TOO_OLD", "warning", k, f"{_d(k)} <= DATE '{TODAY}' AND year({_d(k)}) < 1850"))],
    ("DATE_ORDER", "error", "mutation_date", f"{_d('mutation_date')} < {_d('registration_date')}"),
)


@query(ctes(VALUES) + DATES_SQL)
def rule_dates(spark, sf):
    return _of(spark, sf, rules.dates(TODAY))


@query(ctes(VALUES) + _union(("DATE_ORDER", "error", "mutation_date", f"{_d('mutation_date')} < {_d('registration_date')}")))
def date_order_rule(spark, sf):
    return _of(spark, sf, rules.dates(TODAY)).where("rule = 'DATE_ORDER'")


_CLASSES = ", ".join(f"'{c}'" for c in LAND_CLASSES)
CLASS_SQL = _union(("CLASS_UNMAPPED", "warning", "land_classification", f"{_g('land_classification')} NOT IN ({_CLASSES})"))


@query(ctes(VALUES) + CLASS_SQL)
def rule_class(spark, sf):
    return _of(spark, sf, rules.land_classification())


OWNERSHIP_SQL = _union(
    ("OWNER_FATHER_SAME", "warning", "father_name", "lower(trim(owner_name)) = lower(trim(father_name))"),
    ("SHARE_INVALID", "error", "share", "share IN ('1/0', '0%')"), ("SHARE_OVER_UNITY", "error", "share", "share IN ('7/5', '150%')"),
)


@query(ctes(VALUES) + OWNERSHIP_SQL)
def rule_ownership(spark, sf):
    return _of(spark, sf, rules.ownership())


LINKED_SQL = _union(*[c for k in ("mutation", "registration") for c in ((f"{k.upper()}_DATE_MISSING", "warning", f"{k}_date", f"{_g(k + '_number')} IS NOT NULL AND {_g(k + '_date')} IS NULL"), (f"{k.upper()}_NUMBER_MISSING", "warning", f"{k}_number", f"{_g(k + '_date')} IS NOT NULL AND {_g(k + '_number')} IS NULL"))])


@query(ctes(VALUES) + LINKED_SQL)
def rule_linked(spark, sf):
    return _of(spark, sf, rules.linked_records())


_PLACE = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
PLACEHOLDER_SQL = _union(*[("PLACEHOLDER_VALUE", "error" if FIELD[k].required else "warning", k, f"trim(regexp_replace(lower({_g(k)}), '[^a-z0-9/. ]', '', 'g')) IN ({_PLACE})") for k in rules.NAMED])


@query(ctes(VALUES) + PLACEHOLDER_SQL)
def rule_placeholder(spark, sf):
    return _of(spark, sf, rules.placeholders())


def confidence(key: str):
    return ((F.col("id") * 17 + KEYS.index(key) * 37) % 1000).cast("double") / 1000


def _conf(key: str) -> str:
    return f"((id * 17 + {KEYS.index(key) * 37}) % 1000)::DOUBLE / 1000"


LOW_SQL = " UNION ALL ".join(f"SELECT id, 'LOW_CONFIDENCE' AS rule, CASE WHEN {str(FIELD[k].required).lower()} AND {_conf(k)} < 0.55 THEN 'error' ELSE 'warning' END AS severity, '{k}' AS field FROM rec_values WHERE {k} IS NOT NULL AND {_conf(k)} < 0.80" for k in KEYS)


@query(ctes(VALUES) + LOW_SQL)
def rule_low_confidence(spark, sf):
    return _of(spark, sf, rules.low_confidence(confidence))


def _k(e: str) -> str:
    return f"regexp_replace(lower(coalesce({e}, '')), '[^a-z0-9]', '', 'g')"


HIERARCHY_CTES = f""",
m AS (SELECT {_k('state')} AS sk, {_k('district')} AS dk, {_k('tehsil')} AS tk, {_k('village')} AS vk FROM admin),
h AS (SELECT r.*, {_k('r.state')} AS sk, {_k('r.district')} AS dk, {_k('r.tehsil')} AS tk, {_k('r.village')} AS vk FROM rec_values r WHERE coalesce(district, '') <> ''),
k AS (SELECT h.*, (SELECT max(sk) FROM m WHERE m.dk = h.dk) AS m_sk, EXISTS (SELECT 1 FROM m WHERE m.dk = h.dk AND m.tk = h.tk) AS t_ok, EXISTS (SELECT 1 FROM m WHERE m.dk = h.dk AND m.vk = h.vk) AS v_known, EXISTS (SELECT 1 FROM m WHERE m.dk = h.dk AND m.vk = h.vk AND m.tk = h.tk) AS v_ok FROM h)
"""
HIERARCHY_SQL = """SELECT id, 'DISTRICT_UNKNOWN' AS rule, 'warning' AS severity, 'district' AS field FROM k WHERE m_sk IS NULL
UNION ALL SELECT id, 'STATE_MISMATCH', 'error', 'state' FROM k WHERE m_sk IS NOT NULL AND coalesce(state, '') <> '' AND sk <> m_sk
UNION ALL SELECT id, 'STATE_INFERRED', 'info', 'state' FROM k WHERE m_sk IS NOT NULL AND coalesce(state, '') = ''
UNION ALL SELECT id, 'TEHSIL_MISMATCH', 'warning', 'tehsil' FROM k WHERE m_sk IS NOT NULL AND coalesce(tehsil, '') <> '' AND NOT t_ok
UNION ALL SELECT id, 'VILLAGE_TEHSIL_MISMATCH', 'warning', 'village' FROM k WHERE m_sk IS NOT NULL AND coalesce(tehsil, '') <> '' AND t_ok AND coalesce(village, '') <> '' AND v_known AND NOT v_ok"""


@query(ctes(VALUES, "admin") + HIERARCHY_CTES + HIERARCHY_SQL)
def rule_hierarchy(spark, sf):
    h = rules.hierarchy(frame(spark, sf, VALUES), frame(spark, sf, "admin"))
    return listed(h.select("id", F.col("hierarchy_issues").alias("i")))


SIGNATURE = "CASE WHEN coalesce(khasra_number, '') <> '' AND coalesce(village, '') <> '' THEN concat(" + _k("khasra_number") + ", '|', " + _k("village") + ", '|', " + _k("district") + ") END"


@query(ctes(VALUES) + f", s AS (SELECT id, {SIGNATURE} AS sig, lower(trim(coalesce(owner_name, ''))) AS owner FROM rec_values) SELECT a.id, b.id AS earlier_id, CASE WHEN a.owner <> '' AND b.owner <> '' AND a.owner <> b.owner THEN 'DUPLICATE_CONFLICT' ELSE 'DUPLICATE' END AS rule, CASE WHEN a.owner <> '' AND b.owner <> '' AND a.owner <> b.owner THEN 'error' ELSE 'warning' END AS severity FROM s a JOIN s b ON a.sig = b.sig AND b.id < a.id")
def rule_duplicates(spark, sf):
    return rules.duplicates(frame(spark, sf, VALUES))


ALL = "all_issues AS (" + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in (REQUIRED_SQL, AREA_SQL, FORMATS_SQL, DATES_SQL, HIERARCHY_SQL, CLASS_SQL, OWNERSHIP_SQL, LINKED_SQL, PLACEHOLDER_SQL, LOW_SQL)) + ")"
_PRESENT = " + ".join(f"(CASE WHEN {k} IS NOT NULL THEN 1 ELSE 0 END)" for k in KEYS)
_TOTAL = " + ".join(f"(CASE WHEN {k} IS NOT NULL THEN {_conf(k)} ELSE 0 END)" for k in KEYS)
DECISION_SQL = ctes(VALUES, "admin") + HIERARCHY_CTES.rstrip() + ",\n" + ALL + f""",
n AS (SELECT id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i FROM all_issues GROUP BY id)
SELECT r.id, coalesce(e, 0)::INT AS error_count, coalesce(w, 0)::INT AS warning_count, coalesce(i, 0)::INT AS info_count, CASE WHEN coalesce(e, 0) > 0 THEN 'blocked' WHEN coalesce(w, 0) > 0 THEN 'needs_review' ELSE 'auto_approved' END AS decision,
  greatest(0.0::DOUBLE, round((({_TOTAL})::DOUBLE / ({_PRESENT}) - least(0.6::DOUBLE, coalesce(e, 0) * 0.18::DOUBLE + coalesce(w, 0) * 0.06::DOUBLE)) * 100, 1)) AS trust_score, {SIGNATURE} AS signature
FROM rec_values r LEFT JOIN n USING (id)"""


def _validated(spark, sf):
    return rules.validate(frame(spark, sf, VALUES), confidence, TODAY, frame(spark, sf, "admin"))


@query(DECISION_SQL)
def rule_decision_trust(spark, sf):
    return _validated(spark, sf).select("id", "error_count", "warning_count", "info_count", "decision", "trust_score", "signature")


@query(ctes(VALUES, "admin") + HIERARCHY_CTES.rstrip() + ",\n" + ALL + " SELECT rule, count(*) AS count, arg_min(severity, id) AS severity FROM all_issues GROUP BY rule ORDER BY count DESC, rule LIMIT 10")
def agg_issue_frequency(spark, sf):
    i = _validated(spark, sf).select("id", F.posexplode("issues").alias("pos", "x")).select("id", "pos", "x.rule", "x.severity")
    return stats.issue_frequency(i)


@query(ctes(VALUES, "admin") + HIERARCHY_CTES.rstrip() + ",\n" + ALL + " SELECT id, rule, severity, field FROM all_issues WHERE severity = 'error'")
def arr_issue_inline(spark, sf):
    v = _validated(spark, sf).select("id", F.inline("issues"))
    return v.where("severity = 'error'").select("id", "rule", "severity", "field")


@query(ctes(VALUES) + f", all_issues AS ({AREA_SQL}) SELECT id, count(*) AS n, min(rule) AS first_rule FROM all_issues GROUP BY id")
def json_issues_roundtrip(spark, sf):
    j = frame(spark, sf, VALUES).select("id", F.to_json(rules.area_sanity()).alias("issues_json"))
    back = j.select("id", F.explode(F.from_json("issues_json", rules.ISSUE)).alias("x"))
    return back.groupBy("id").agg(F.count("*").alias("n"), F.min("x.rule").alias("first_rule"))


@query(ctes(VALUES) + """, x AS (SELECT id, CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS more, id % 3 AS w FROM rec_values)
SELECT id, (w + more)::BIGINT AS warning_count, CASE WHEN w = 0 AND more = 0 THEN 'auto_approved' ELSE 'needs_review' END AS decision FROM x""")
def rule_enrichment(spark, sf):
    blank = F.array().cast(rules.ISSUE)
    extra = rules.found((F.col("id") % 10 == 0, rules.issue("SEAL_MISSING", "warning", None, "no seal")), (F.col("id") % 5 == 0, rules.issue("HANDWRITING_SUSPECTED", "warning", None, "handwriting")))
    v = frame(spark, sf, VALUES).select("id", blank.alias("issues"), (F.col("id") % 3).alias("warning_count"), F.when(F.col("id") % 3 == 0, "auto_approved").otherwise("needs_review").alias("decision"), extra.alias("extra"))
    return rules.enrich(v, "extra").select("id", F.col("warning_count").cast("long").alias("warning_count"), "decision")


@query(ctes("parcels") + """, m AS (SELECT map_id, list(khasra_number) AS labels FROM parcels GROUP BY map_id)
SELECT parcel_id AS id, CASE WHEN parcel_id % 4 = 0 THEN 'MAP_CONFIRMS_KHASRA' WHEN parcel_id % 4 = 3 THEN 'MAP_KHASRA_MISMATCH' ELSE 'MAP_SHOWS_KHASRA' END AS rule FROM parcels JOIN m USING (map_id) WHERE parcel_id % 4 <> 3 OR len(labels) >= 3""")
def rule_map_cross_check(spark, sf):
    p = frame(spark, sf, "parcels")
    m = p.groupBy("map_id").agg(F.collect_list("khasra_number").alias("labels"))
    khasra = F.when(F.col("parcel_id") % 4 == 3, "none such").otherwise(F.col("khasra_number"))
    subject = F.when(F.col("parcel_id") % 4 == 0, F.col("khasra_number"))
    j = p.join(m, "map_id").select(F.col("parcel_id").alias("id"), rules.map_cross_check(khasra, F.col("labels"), subject).alias("i"))
    return listed(j).select("id", "rule")


@query(ctes("parcels") + """, a AS (SELECT parcel_id AS id, (x1 - x0) * (y1 - y0) * CASE parcel_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.1 ELSE 1.5 END AS sqm, (x1 - x0) * (y1 - y0) AS mapped FROM parcels)
SELECT id, 'GEO_TAGGED' AS rule FROM a UNION ALL SELECT id, CASE WHEN id % 3 = 2 THEN 'GEO_AREA_MISMATCH' ELSE 'GEO_AREA_VERIFIED' END FROM a""")
def rule_geo_area(spark, sf):
    p = frame(spark, sf, "parcels")
    mapped = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    factor = F.when(F.col("parcel_id") % 3 == 0, 1.0).when(F.col("parcel_id") % 3 == 1, 1.1).otherwise(1.5)
    return listed(p.select(F.col("parcel_id").alias("id"), rules.geo_area(mapped * factor, mapped).alias("i"))).select("id", "rule")


def _matched(spark, sf):
    r = frame(spark, sf, VALUES).select("id", "khasra_number", "village", "owner_name", "land_classification", "area")
    return registry.exact(r, frame(spark, sf, "registry"))


MATCHED = f", m AS (SELECT r.id, g.source_id, r.owner_name, r.land_classification, r.area, g.owner_name AS reg_owner, g.area_sqm, g.land_classification AS reg_class FROM rec_values r JOIN registry g ON {_k('r.khasra_number')} = {_k('g.khasra_number')} AND {_k('r.village')} = {_k('g.village')} WHERE {_k('r.khasra_number')} <> '')"


@query(ctes(VALUES, "registry") + MATCHED + " SELECT id, source_id, reg_owner FROM m")
def join_registry_exact(spark, sf):
    return _matched(spark, sf).select("id", "source_id", "reg_owner")


@query(ctes(VALUES, "registry") + MATCHED + f""", f AS (SELECT m.*, abs(sqm - area_sqm) / area_sqm AS off FROM m LEFT JOIN {AREAS} ON area = raw),
i AS (SELECT id, source_id, 'FACT_CHECK_OWNER_MISMATCH' AS rule, 'error' AS severity FROM f WHERE coalesce(owner_name, '') <> '' AND lower(trim(owner_name)) <> lower(trim(reg_owner))
  UNION ALL SELECT id, source_id, 'FACT_CHECK_AREA_MISMATCH', CASE WHEN off >= 0.5 THEN 'error' ELSE 'warning' END FROM f WHERE off >= 0.15
  UNION ALL SELECT id, source_id, 'FACT_CHECK_CLASS_MISMATCH', 'warning' FROM f WHERE coalesce(land_classification, '') <> '' AND land_classification <> reg_class)
SELECT * FROM i UNION ALL SELECT id, source_id, 'FACT_CHECK_VERIFIED', 'info' FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.id = f.id AND i.source_id = f.source_id)""")
def rule_fact_check(spark, sf):
    return registry.fact_check(_matched(spark, sf), parse_area(F.col("area"))["sqm"], fuzzy_owner=False)


@query()
def rule_fact_check_fuzzy_owner(spark, sf):
    return registry.fact_check(_matched(spark, sf), parse_area(F.col("area"))["sqm"])


@query()
def topk_registry_best_match(spark, sf):
    return registry.best_match(frame(spark, sf, VALUES).where("khasra_number IS NOT NULL AND village IS NOT NULL"), frame(spark, sf, "registry_offices"))


#: A phrase table that the invented prose can meet; the shipped one is for land records.
PHRASES = {
    "record_of_rights": (("the ", 1.0), ("tion", 2.0), ("license", 4.0)),
    "sale_deed": (("der ", 3.0), ("ung", 2.5), ("nicht", 2.0)),
    "mutation_order": (("de la", 3.0), ("que", 2.0), ("ción", 4.0)),
    "stamp_certificate": (("|", 4.0), ("%%%", 5.0)),
}


def _score(name: str) -> str:
    return " + ".join(f"(CASE WHEN contains(low, '{p}') THEN {w} ELSE 0 END)" for p, w in PHRASES[name])


SCORED = ", ".join(f"({_score(n)})::DOUBLE AS {n}" for n in PHRASES)
LOW = "SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS low FROM documents"


@query(f"SELECT doc_id, {SCORED} FROM ({LOW})")
def str_doc_type_scores(spark, sf):
    d = base(spark, sf, "documents")
    return d.select("doc_id", *[c.alias(n) for n, c in doctype.scores(F.col("text"), PHRASES).items()])


@query(f"""WITH s AS (SELECT doc_id, {SCORED} FROM ({LOW})),
r AS (SELECT doc_id, stamp_certificate AS st, list_sort([(-record_of_rights, 0, 'record_of_rights'), (-sale_deed, 1, 'sale_deed'), (-mutation_order, 2, 'mutation_order')]) AS l FROM s),
x AS (SELECT doc_id, st, -l[1][1] AS best, l[1][3] AS name, round(-l[1][1] + l[2][1], 2) AS margin FROM r)
SELECT doc_id, CASE WHEN best >= 4 AND margin >= 2 THEN name WHEN st >= 4 THEN 'stamp_certificate' ELSE 'unknown' END AS doc_type, best AS doc_score, margin AS doc_margin, CASE WHEN best >= 4 AND margin >= 2 AND st >= 4 THEN 'stamp_certificate' END AS doc_carrier FROM x""")
def str_doc_type_detect(spark, sf):
    d = doctype.detect(base(spark, sf, "documents"), "text", PHRASES)
    return d.select("doc_id", "doc_type", "doc_score", "doc_margin", "doc_carrier")
