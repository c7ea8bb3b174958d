"""Queries over text: normal forms, similarity, identifiers, dates, readers and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as t
from ..functions.parse import parse_date
from ..functions.vocab import LAND_CLASSES
from ..operators import extraction, gazetteer, geocode, learning, measures, stats, vertical
from ..sources import readers
from .bindings import base, ctes, frame
from .registry import query

DOCS = "documents"


def _docs(spark, sf):
    return base(spark, sf, DOCS)


@query(r"SELECT doc_id, trim(regexp_replace(translate(text, ';', ':'), '\s+', ' ', 'g')) AS norm FROM documents")
def str_normalise(spark, sf):
    return _docs(spark, sf).select("doc_id", t.normalise(F.col("text")).alias("norm"))


@query()
def str_normalise_nfc(spark, sf):
    return _docs(spark, sf).select("doc_id", similarity.nfc(t.normalise(F.col("text"))).alias("norm"))


@query("SELECT c_custkey, concat('', c_custkey) AS folded, concat('', c_custkey) AS native_folded FROM customer")
def str_digits_fold(spark, sf):
    native = F.translate(F.col("c_custkey").cast("string"), "0123456789", "०१२३४५६७८९")
    return base(spark, sf, "customer").select("c_custkey", t.fold_digits(F.col("c_custkey").cast("string")).alias("folded"), t.fold_digits(native).alias("native_folded"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('1', o_custkey) WHEN 1 THEN concat(o_custkey, '/2B') WHEN 2 THEN concat('5', o_custkey, '/0') ELSE concat('8', o_custkey) END AS cleaned FROM orders")
def str_clean_number(spark, sf):
    k = F.col("o_custkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("l"), k)).when(F.col("o_orderkey") % 4 == 1, F.concat(k, F.lit(" /2B"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("S"), k, F.lit("/O"))).otherwise(F.concat(F.lit("B"), k, F.lit("-")))
    return base(spark, sf, "orders").select("o_orderkey", t.clean_number(raw).alias("cleaned"))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 THEN 'latin' ELSE 'unknown' END AS script FROM documents")
def str_detect_script(spark, sf):
    return _docs(spark, sf).select("doc_id", t.detect_script(F.col("text")).alias("script"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9ऀ-ॿ]', '', 'g') AS key FROM documents")
def str_compare_key(spark, sf):
    return _docs(spark, sf).select("doc_id", t.compare_key(F.col("text")).alias("key"))


ROMAN = "regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(replace(lower({0}), 'au', 'o'), 'ai', 'e'), '[^a-z]', '', 'g'), 'w', 'v'), 'q', 'k'), 'x', 'ks'), 'oo', 'u'), 'ee', 'i'), 'a$', '')"


@query(f"SELECT s_suppkey, {ROMAN.format('s_name')} AS folded FROM supplier UNION ALL SELECT n_nationkey::BIGINT, {ROMAN.format('n_name')} FROM nation")
def str_fold_roman(spark, sf):
    a = base(spark, sf, "supplier").select("s_suppkey", t.fold_roman(F.col("s_name")).alias("folded"))
    return a.unionByName(base(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), t.fold_roman(F.col("n_name")).alias("folded")))


@query(f"SELECT n_nationkey, {ROMAN.format('n_name')} AS phonetic FROM nation")
def str_phonetic_latin(spark, sf):
    return base(spark, sf, "nation").select("n_nationkey", gazetteer.phonetic_key(F.col("n_name")).alias("phonetic"))


@query(f"SELECT n_nationkey, nullif(regexp_replace({ROMAN.format('n_name')}, '[aeiou]', '', 'g'), '') AS skel FROM nation")
def str_skeleton(spark, sf):
    return base(spark, sf, "nation").select("n_nationkey", t.skeleton(t.fold_roman(F.col("n_name"))).alias("skel"))


BIGRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query(f"""WITH p AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE 2.0 * len(list_intersect({BIGRAMS.format('a')}, {BIGRAMS.format('b')})) / (len({BIGRAMS.format('a')}) + len({BIGRAMS.format('b')})) END AS score FROM p""")
def str_dice(spark, sf):
    n = base(spark, sf, "nation")
    p = n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey")
    return p.select("a", "b", t.dice(F.col("a"), F.col("b")).alias("score"))


def _region_pairs(spark, sf):
    n = base(spark, sf, "nation")
    return n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey")


@query()
def str_indel_ratio(spark, sf):
    return _region_pairs(spark, sf).select("a", "b", F.round(similarity.indel_ratio("a", "b"), 6).alias("score"))


@query()
def str_difflib_ratio(spark, sf):
    return _region_pairs(spark, sf).select("a", "b", F.round(similarity.sequence_ratio("a", "b"), 6).alias("score"))


@query()
def str_romanise(spark, sf):
    words = F.array(*[F.lit(w) for w in ("नरहरपुर", "कानपुर", "लखनऊ", "ग्राम", "भोपाल", "सड़क")])
    return base(spark, sf, "nation").select("n_nationkey", F.get(words, F.col("n_nationkey") % 6).alias("w")).select("n_nationkey", similarity.romanised("w").alias("roman"), gazetteer.phonetic_key(F.col("w")).alias("phonetic"))


@query(ctes("rec_values") + """SELECT id, CASE WHEN trim(coalesce(khasra_number, '')) = '' THEN 'unusable' WHEN regexp_matches(khasra_number, '^[0-9]{1,6}(/[0-9]{1,4}[A-Za-z]?){0,3}$') THEN 'confirmed' ELSE 'invalid_shape' END AS khasra,
  CASE WHEN trim(coalesce(ulpin, '')) = '' THEN 'unusable' WHEN regexp_matches(ulpin, '^[A-Z0-9]{14}$') THEN 'confirmed' ELSE 'invalid_shape' END AS ulpin FROM rec_values""")
def str_identifier_shape(spark, sf):
    return frame(spark, sf, "rec_values").select("id", gazetteer.check_identifier(F.col("khasra_number"), "khasra_number").alias("khasra"), gazetteer.check_identifier(F.col("ulpin"), "ulpin").alias("ulpin"))


_WORDS = "(VALUES " + ", ".join(f"('{w}', '{c}', {len(w)}, {i})" for i, (c, ws) in enumerate(LAND_CLASSES.items()) for w in ws) + ") w(word, code, n, ord)"


@query(f"SELECT o_orderkey, (SELECT code FROM {_WORDS} WHERE contains(CASE o_orderkey % 5 WHEN 0 THEN 'unirrigated land' WHEN 1 THEN 'old forest road' WHEN 2 THEN 'असिंचित' WHEN 3 THEN 'gram sabha pond' ELSE 'zzz' END, word) ORDER BY n DESC, ord LIMIT 1) AS code FROM orders")
def str_controlled_vocab(spark, sf):
    value = F.when(F.col("o_orderkey") % 5 == 0, "unirrigated land").when(F.col("o_orderkey") % 5 == 1, "Old forest road").when(F.col("o_orderkey") % 5 == 2, "असिंचित").when(F.col("o_orderkey") % 5 == 3, "gram sabha pond").otherwise("zzz")
    return base(spark, sf, "orders").select("o_orderkey", gazetteer.controlled_class(value).alias("code"))


@query(r"SELECT doc_id, contains(regexp_replace(lower(text), '\s', '', 'g'), 'license') AS a, contains(regexp_replace(lower(text), '\s', '', 'g'), 'tionofthe') AS b FROM documents")
def str_grounding(spark, sf):
    return _docs(spark, sf).select("doc_id", t.grounded(F.lit("Lic ense"), F.col("text")).alias("a"), t.grounded(F.lit("tion of the"), F.col("text")).alias("b"))


@query("SELECT item_id, len(ws) AS words, greatest(len(ws) - 1, 0) AS pairs, ws[1] || ' ' || ws[2] AS first_pair FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM benchmark) WHERE len(ws) >= 2")
def str_tokens_ngrams(spark, sf):
    ws = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    b = base(spark, sf, "benchmark").select("item_id", ws.alias("ws")).where(F.size("ws") >= 2)
    pairs = t.word_ngrams(F.col("ws"), 2)
    return b.select("item_id", F.size("ws").cast("long").alias("words"), F.size(pairs).cast("long").alias("pairs"), F.get(pairs, 0).alias("first_pair"))


@query(ctes("rec_corrections") + "SELECT id, concat(field_key, '::', regexp_replace(lower(ai_value), '[^a-z0-9]', '', 'g')) AS alias_key FROM rec_corrections")
def str_alias_key(spark, sf):
    return frame(spark, sf, "rec_corrections").select("id", F.concat_ws("::", "field_key", t.compare_key(F.col("ai_value"))).alias("alias_key"))


@query("SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS skel FROM documents")
def str_digit_skeleton(spark, sf):
    return _docs(spark, sf).select("doc_id", t.digit_skeleton(F.col("text")).alias("skel"))


def _ids(spark, sf):
    p = base(spark, sf, "part").select("p_partkey", F.concat(F.lit("UP"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("parcel"), F.concat(F.lit("F"), F.lpad((F.col("p_size") + 1).cast("string"), 2, "0")).alias("lvl"), (1 + F.col("p_partkey") % 9).cast("int").alias("unit"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).alias("bld"))
    return p


ID_SQL = "SELECT p_partkey, concat('UP', lpad(concat('', p_partkey), 12, '0'), CASE WHEN p_partkey % 3 = 0 THEN concat('-', lpad(concat('', p_size), 2, '0')) ELSE '' END, '-F', lpad(concat('', p_size + 1), 2, '0'), '-', lpad(concat('', 1 + p_partkey % 9), 3, '0')) AS ulpin_3d FROM part"


@query(ID_SQL)
def str_ulpin_make(spark, sf):
    return _ids(spark, sf).select("p_partkey", vertical.make_id(F.col("parcel"), F.col("lvl"), F.col("unit"), F.col("bld")).alias("ulpin_3d"))


@query("SELECT p_partkey, concat('UP', lpad(concat('', p_partkey), 12, '0')) AS parcel_ulpin, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS building, concat('F', lpad(concat('', p_size + 1), 2, '0')) AS level_code, 'floor' AS level_kind, p_size + 1 AS level_number, (1 + p_partkey % 9)::INT AS unit FROM part")
def str_ulpin_parse(spark, sf):
    made = _ids(spark, sf).select("p_partkey", vertical.parse_id(vertical.make_id(F.col("parcel"), F.col("lvl"), F.col("unit"), F.col("bld"), with_check=True)).alias("p"))
    return made.select("p_partkey", "p.parcel_ulpin", "p.building", "p.level_code", "p.level_kind", "p.level_number", "p.unit")


@query(f"WITH i AS ({ID_SQL}), c AS (SELECT p_partkey, ulpin_3d, list_reduce(list_prepend(0, list_transform(list_filter(str_split(ulpin_3d, ''), lambda x: x <> '-'), lambda x: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1)), lambda p, v: ((p + v) * 2) % 37) AS p FROM i) SELECT p_partkey, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*', ((38 - p) % 37 + 1)::BIGINT, 1) AS check_character FROM c")
def str_check_char(spark, sf):
    made = vertical.make_id(F.col("parcel"), F.col("lvl"), F.col("unit"), F.col("bld"))
    return _ids(spark, sf).select("p_partkey", vertical.check_character(made).alias("check_character"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_parse_dmy(spark, sf):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "d.M.yyyy")).when(k == 2, F.date_format("o_orderdate", "dd MMM yyyy")).otherwise(F.concat(F.lit("dated "), F.date_format("o_orderdate", "d-M-yy"), F.lit(" here")))
    return base(spark, sf, "orders").select("o_orderkey", parse_date(raw).alias("iso"))


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS iso, NULL::VARCHAR AS none FROM lineitem")
def date_parse_iso(spark, sf):
    return base(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", parse_date(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("iso"), parse_date(F.lit("13/25/2019")).alias("none"))


@query("SELECT doc_id, line_no, text FROM (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS text FROM (SELECT doc_id, str_split(text, chr(10)) AS ls FROM documents)) WHERE trim(text) <> ''".replace("unnest(range(0, len(ls)))", "unnest(range(0, len(ls)))::INT"))
def read_lines_from_documents(spark, sf):
    return readers.text_lines(_docs(spark, sf), "text", ("doc_id",))


@query()
def read_html_text(spark, sf):
    p = readers.page_lines(base(spark, sf, "pages"))
    return p.select("page_id", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("text"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def read_html_title(spark, sf):
    return base(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query()
def read_csv_rows_to_lines(spark, sf):
    """Customers as delimited files of a header and a row, read back through the reader."""

    @F.pandas_udf("array<string>")
    def lines(raw):
        return raw.map(lambda s: readers.delimited_lines(s.encode()))

    c = base(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Khasra No;Owner;Tehsil\n"), F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), F.lit("\n")).alias("raw"))
    return c.select("c_custkey", F.array_join(lines("raw"), "\n").alias("lines"))


def _form_lines(spark, sf):
    """Records printed as forms of label and value lines."""
    v = frame(spark, sf, "rec_values").where("khasra_number IS NOT NULL AND owner_name IS NOT NULL AND area IS NOT NULL AND village IS NOT NULL")
    lines = F.array(F.concat(F.lit("Khasra No : "), F.col("khasra_number")), F.concat(F.lit("Owner Name: "), F.col("owner_name")), F.concat(F.lit("Plot Area : "), F.col("area")), F.lit("Village:"), F.col("village"))
    return v.select(F.col("id").alias("doc"), F.posexplode(lines).alias("line_no", "text")).withColumn("ocr", F.lit(0.95))


@query()
def read_extract_fields(spark, sf):
    return extraction.extract_fields(_form_lines(spark, sf))


@query(ctes("rec_values") + """SELECT id AS doc, 'village' AS field_key, village AS value, 0.9158::DOUBLE AS confidence, 3 AS line_no, 'extracted' AS status FROM rec_values WHERE khasra_number IS NOT NULL AND owner_name IS NOT NULL AND area IS NOT NULL AND village IS NOT NULL
UNION ALL SELECT id, 'owner_name', owner_name, CASE WHEN regexp_matches(owner_name, '[0-9]') THEN 0.7334 ELSE 0.8398 END, 1, 'needs_review' FROM rec_values WHERE khasra_number IS NOT NULL AND owner_name IS NOT NULL AND area IS NOT NULL AND village IS NOT NULL""")
def read_extract_named(spark, sf):
    """Owners beside their label, and villages on the line below it."""
    return extraction.extract_fields(_form_lines(spark, sf)).where("field_key IN ('owner_name', 'village')")


@query()
def str_fuzzy_label(spark, sf):
    heads = F.array(*[F.lit(x) for x in ("khasra nunber", "vilage", "ownr name", "distict", "something else")])
    n = base(spark, sf, "nation").select("n_nationkey", F.get(heads, F.col("n_nationkey") % 5).alias("head"))
    return n.select("n_nationkey", "head", extraction.fuzzy_label(F.col("head")).alias("f")).select("n_nationkey", "head", "f.key", "f.score")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dates FROM orders")
def date_from_prose(spark, sf):
    text = F.concat(F.lit("order 123456789/12.03.2001 dated "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" was entered"))
    return base(spark, sf, "orders").select("o_orderkey", F.array_join(extraction.dates_in_prose(text), ",").alias("dates"))


@query(ctes("rec_corrections") + """, c AS (SELECT field_key, regexp_replace(lower(ai_value), '[^a-z0-9]', '', 'g') AS akey, human_value FROM rec_corrections WHERE field_key IN ('village', 'district') AND ai_value <> human_value),
v AS (SELECT field_key, akey, human_value, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field_key, akey ORDER BY n DESC, human_value) AS rn, sum(n) OVER (PARTITION BY field_key, akey) AS total FROM v)
SELECT field_key, akey, human_value AS corrected_value, n AS support, round(n / total, 3) AS agreement, n / total >= 0.8 AS auto_apply FROM r WHERE rn = 1 AND n >= 3""")
def learn_aliases(spark, sf):
    return learning.aliases(frame(spark, sf, "rec_corrections"))


@query(ctes("rec_corrections") + """, c AS (SELECT * FROM rec_corrections WHERE ai_value <> human_value),
p AS (SELECT field_key, '4' AS from_char, '1' AS to_char FROM c WHERE field_key = 'khata_number' UNION ALL SELECT field_key, '-', ' ' FROM c WHERE field_key <> 'khata_number'
  UNION ALL SELECT field_key, right(ai_value, 1), '9' FROM c WHERE field_key <> 'khata_number' AND right(human_value, 1) = '9')
SELECT from_char, to_char, count(*) AS support, bool_or(field_key = 'khata_number') AND regexp_matches(to_char, '^[0-9]$') AS auto_apply FROM p GROUP BY 1, 2 HAVING count(*) >= 4""")
def learn_confusions(spark, sf):
    return learning.mined_confusions(frame(spark, sf, "rec_corrections"))


@query("SELECT c_custkey, coalesce(string_agg(substr(v, 1, i - 1) || '1' || substr(v, i + 1), ',' ORDER BY i), '') AS variants FROM (SELECT c_custkey, concat('', c_custkey) AS v, unnest(range(1, length(concat('', c_custkey)) + 1)) AS i FROM customer) WHERE substr(v, i, 1) = '4' GROUP BY c_custkey")
def learn_confusion_variants(spark, sf):
    c = base(spark, sf, "customer").select("c_custkey", F.array_join(learning.variants(F.col("c_custkey").cast("string"), "4", "1"), ",").alias("variants"))
    return c.where("variants <> ''")


@query(ctes("rec_fields") + """, a AS (SELECT field_key, count(*) FILTER (status = 'corrected') AS c, count(*) FILTER (status IN ('corrected', 'confirmed')) AS reviewed, round(avg(ai_confidence), 4) AS avg_conf FROM rec_fields GROUP BY field_key),
m AS (SELECT field_key, reviewed, greatest(0.5::DOUBLE, least(1.15::DOUBLE, (round(1 - c / reviewed, 4) / avg_conf - 1) * least(1.0::DOUBLE, reviewed / 40.0::DOUBLE) + 1)) AS m FROM a WHERE reviewed >= 8 AND avg_conf > 0)
SELECT field_key, reviewed, round(m, 4) AS multiplier, CASE WHEN m < 0.98 THEN 'deflate' WHEN m > 1.02 THEN 'inflate' ELSE 'stable' END AS direction FROM m""")
def math_calibration(spark, sf):
    return learning.calibration(stats.field_accuracy(frame(spark, sf, "rec_fields")))


@query(ctes("rec_corrections") + """, c AS (SELECT field_key, regexp_replace(lower(ai_value), '[^a-z0-9]', '', 'g') AS akey, human_value FROM rec_corrections WHERE field_key IN ('village', 'district') AND ai_value <> human_value),
v AS (SELECT field_key, akey, human_value, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field_key, akey ORDER BY n DESC, human_value) AS rn, sum(n) OVER (PARTITION BY field_key, akey) AS total FROM v),
a AS (SELECT field_key, akey, human_value FROM r WHERE rn = 1 AND n >= 3 AND n / total >= 0.8)
SELECT t.id, coalesce(a.human_value, t.ai_value) AS value, coalesce(a.human_value <> t.ai_value, false) AS learned FROM rec_corrections t LEFT JOIN a ON a.field_key = t.field_key AND a.akey = regexp_replace(lower(t.ai_value), '[^a-z0-9]', '', 'g')""")
def learn_apply(spark, sf):
    c = frame(spark, sf, "rec_corrections")
    fields = c.select("id", "field_key", F.col("ai_value").alias("value"))
    return learning.apply_aliases(fields, learning.aliases(c)).select("id", "value", "learned")


@query(ctes("rec_fields") + """, a AS (SELECT field_key, count(*) FILTER (status = 'corrected') AS c, count(*) FILTER (status IN ('corrected', 'confirmed')) AS reviewed, round(avg(ai_confidence), 4) AS avg_conf FROM rec_fields GROUP BY field_key),
m AS (SELECT field_key, round(greatest(0.5::DOUBLE, least(1.15::DOUBLE, (round(1 - c / reviewed, 4) / avg_conf - 1) * least(1.0::DOUBLE, reviewed / 40.0::DOUBLE) + 1)), 4) AS m FROM a WHERE reviewed >= 8 AND avg_conf > 0),
x AS (SELECT document_id, f.field_key, status, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ai_confidence * coalesce(m, 1))) AS conf, ai_confidence FROM rec_fields f LEFT JOIN m ON m.field_key = f.field_key)
SELECT document_id, field_key, CASE WHEN ai_confidence IS NULL THEN 0.0 ELSE round(conf, 7) END AS new_confidence, CASE WHEN status IN ('missing', 'needs_review') THEN status WHEN CASE WHEN ai_confidence IS NULL THEN 0 ELSE conf END < 0.90 THEN 'needs_review' ELSE 'extracted' END AS new_status FROM x""")
def learn_recalibrate(spark, sf):
    f = frame(spark, sf, "rec_fields")
    m = learning.calibration(stats.field_accuracy(f))
    return learning.apply_calibration(f.withColumn("ai_confidence", F.coalesce("ai_confidence", F.lit(0.0))), m).select("document_id", "field_key", "new_confidence", "new_status")


@query(ctes("registry") + """, f AS (SELECT c_custkey AS id, concat('village ', c_custkey % 60) AS village, replace(concat(c_custkey % 500, '/', 1 + c_custkey % 9), '1', '4') AS value FROM customer),
v AS (SELECT id, village, value, value AS variant FROM f UNION SELECT id, village, value, substr(value, 1, i - 1) || '1' || substr(value, i + 1) FROM (SELECT *, unnest(range(1, length(value) + 1)) AS i FROM f) WHERE substr(value, i, 1) = '4'),
h AS (SELECT v.id, v.village, v.value, max((variant = value AND k.khasra_number IS NOT NULL)::INT) AS own, list_sort(list(DISTINCT variant) FILTER (variant <> value AND k.khasra_number IS NOT NULL)) AS hits FROM v LEFT JOIN (SELECT DISTINCT village, khasra_number FROM registry) k ON k.village = v.village AND k.khasra_number = variant GROUP BY v.id, v.village, v.value)
SELECT id, village, value, CASE WHEN own = 1 THEN 'vouched' WHEN len(hits) = 1 THEN 'repaired' WHEN len(hits) > 1 THEN 'ambiguous' ELSE 'unknown' END AS outcome, CASE WHEN own = 0 AND len(hits) = 1 THEN hits[1] ELSE value END AS new_value FROM h""")
def learn_repair(spark, sf):
    c = base(spark, sf, "customer")
    f = c.selectExpr("c_custkey AS id", "concat('village ', c_custkey % 60) AS village", "replace(concat(c_custkey % 500, '/', 1 + c_custkey % 9), '1', '4') AS value")
    return learning.repair(f, frame(spark, sf, "registry"), [("4", "1")])


def _scope_values(spark, sf):
    v = frame(spark, sf, "rec_values").where("state IS NOT NULL AND district IS NOT NULL")
    return v.select("id", F.upper("state").alias("state"), F.col("district").alias("value"))


@query()
def topk_fuzzy3(spark, sf):
    names = frame(spark, sf, "admin").select("state", F.col("district").alias("name"))
    return gazetteer.match_in_scope(_scope_values(spark, sf), names, "district", ["state"])


@query(ctes("rec_values", "admin") + """, v AS (SELECT id, upper(state) AS state, district AS value FROM rec_values WHERE state IS NOT NULL AND district IS NOT NULL)
SELECT id, value FROM v WHERE EXISTS (SELECT 1 FROM admin a WHERE a.state = v.state AND lower(a.district) = lower(v.value))""")
def join_gazetteer_confirmed(spark, sf):
    names = frame(spark, sf, "admin").select("state", F.col("district").alias("name"))
    m = gazetteer.match_in_scope(_scope_values(spark, sf), names, "district", ["state"], F.lit(0.0))
    return m.where("outcome = 'confirmed'").select("id", "value")


#: Place names have letters only: digits of the nations' names become letters.
LETTERS = ("0123456789_", "ABCDEFGHIJ ")
NAMED = "translate({0}, '0123456789_', 'ABCDEFGHIJ ')"


def _named(spark, sf):
    return frame(spark, sf, "rec_values").withColumn("district", F.translate("district", *LETTERS))


def _places(spark, sf):
    n, r = base(spark, sf, "nation").withColumn("n_name", F.translate("n_name", *LETTERS)), base(spark, sf, "region")
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    district = j.select(F.lit("district").alias("level"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("lat"), F.col("n_regionkey").cast("double").alias("lon"), F.col("r_name").alias("state"), F.col("n_name").alias("district"))
    state = r.select(F.lit("state").alias("level"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.col("r_name").alias("state"), F.lit(None).cast("string").alias("district"))
    return district.unionByName(state)


FIELDS = {"district": ("district",), "state": ("state",)}


@query(ctes("rec_values") + f"SELECT id, 'district' AS field, {NAMED.format('n_name')} AS name FROM rec_values JOIN nation ON n_name = district UNION ALL SELECT id, 'state', r_name FROM rec_values JOIN region ON lower(r_name) = lower(state)")
def place_exact(spark, sf):
    return geocode.candidates(_named(spark, sf), _places(spark, sf), FIELDS).select("id", "field", "name")


RESOLVED = ctes("rec_values") + f""", f AS (SELECT id, {NAMED.format('n.n_name')} AS d, rg.r_name AS d_state, s.r_name AS s, n.n_nationkey AS n_key, n.n_regionkey AS d_key, s.r_regionkey AS s_key FROM rec_values v LEFT JOIN nation n ON n_name = district LEFT JOIN region rg ON n.n_regionkey = rg.r_regionkey LEFT JOIN region s ON lower(s.r_name) = lower(state))
SELECT id, CASE WHEN d IS NOT NULL AND (s IS NULL OR s = d_state) THEN d ELSE s END AS name, CASE WHEN d IS NOT NULL AND (s IS NULL OR s = d_state) THEN 'district' ELSE 'state' END AS level, CASE WHEN d IS NOT NULL AND (s IS NULL OR s = d_state) THEN 40000 ELSE 300000 END AS accuracy_m,
  CASE WHEN d IS NOT NULL AND (s IS NULL OR s = d_state) THEN n_key ELSE s_key END::DOUBLE AS lat, CASE WHEN d IS NOT NULL AND (s IS NULL OR s = d_state) THEN d_key ELSE 0 END::DOUBLE AS lon,
  d IS NOT NULL AND s IS NOT NULL AND s = d_state AS corroborated, CASE WHEN d IS NOT NULL AND s <> d_state THEN concat(d, ':', d_state) ELSE '' END AS conflicts FROM f WHERE d IS NOT NULL OR s IS NOT NULL"""


@query(RESOLVED)
def place_resolve(spark, sf):
    return geocode.resolve(_named(spark, sf), _places(spark, sf), FIELDS)


@query(f"SELECT id, conflicts FROM ({RESOLVED}) WHERE conflicts <> ''")
def place_conflicts(spark, sf):
    return geocode.resolve(_named(spark, sf), _places(spark, sf), FIELDS).where("conflicts <> ''").select("id", "conflicts")


@query("SELECT o_orderkey, round(CASE WHEN s >= 62 THEN 1.0::DOUBLE WHEN s <= 32 THEN 0.55 ELSE (s - 32) / 30.0::DOUBLE * 0.45 + 0.55 END, 9) AS gate, CASE WHEN s >= 62 THEN 'ok' WHEN s <= 32 THEN 'poor' ELSE 'marginal' END AS label FROM (SELECT o_orderkey, (o_custkey % 101)::DOUBLE AS s FROM orders)")
def math_quality_gate(spark, sf):
    s = (F.col("o_custkey") % 101).cast("double")
    return base(spark, sf, "orders").select("o_orderkey", F.round(measures.quality_gate(s), 9).alias("gate"), measures.gate_label(s).alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((0.32 * least(1.0, l_quantity / 40) + 0.28 * least(1.0, l_discount * 12) + 0.16 * least(1.0, l_tax * 20) + 0.10 + 0.08 * 0.5 + 0.06 * 0) * 100, 1) AS legibility FROM lineitem")
def math_legibility(spark, sf):
    c = F.col
    parts = {"sharpness": c("l_quantity") / 40, "contrast": c("l_discount") * 12, "ink": c("l_tax") * 20, "skew": F.lit(3.0), "illumination": F.lit(0.5), "bleed": F.lit(-1.0)}
    return base(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", measures.legibility(parts).alias("legibility"))
