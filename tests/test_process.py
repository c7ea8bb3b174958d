"""Record correction, the composed pipeline, and the parts that SQL does not check."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotwright.functions.similarity import indel
from plotwright.functions.vocab import FIELD
from plotwright.operators import correction, enrichment, extraction, process, registry, rules, scans, topology

ADMIN = [("Uttar Pradesh", "Lucknow", "Malihabad", "Rampur"), ("Uttar Pradesh", "Lucknow", "Malihabad", "Rampura"), ("Uttar Pradesh", "Lucknow", "Mohanlalganj", "Nigohan"), ("Bihar", "Patna", "Danapur", "Khagaul")]


@pytest.fixture(scope="module")
def admin(spark):
    return spark.createDataFrame(ADMIN, "state string, district string, tehsil string, village string")


def record(spark, *rows):
    empty = dict.fromkeys(FIELD)
    return spark.createDataFrame([(k, *{**empty, **r}.values()) for k, r in enumerate(rows)], "id long, " + ", ".join(f"{k} string" for k in FIELD))


def test_names_are_corrected_from_the_top_down(spark, admin):
    r = record(
        spark,
        {"district": "Lucknou", "tehsil": "Malihabad", "village": "Rampur", "state": "Bihar"},
        {"district": "Nowhere at all", "tehsil": "Danapur", "village": "Khagaul", "state": "Bihar"},
        {"district": "Patna", "tehsil": "Danapr", "village": "Kagaul", "ulpin": "x"},
        {"district": "लखनऊ", "tehsil": " ", "village": "Nigohan"},
    )
    got = {(x.id, x.field_key): (x.outcome, x.new_value) for x in correction.correct_record(r, admin).collect()}
    assert got[0, "district"] == ("corrected", "Lucknow") and got[0, "village"] == ("confirmed", "Rampur") and got[0, "state"] == ("ambiguous", "Bihar")
    assert got[1, "district"][0] == "not_found" and got[1, "tehsil"][0] == got[1, "village"][0] == "no_vocabulary" and got[1, "state"][0] == "confirmed"
    assert got[2, "tehsil"] == ("corrected", "Danapur") and got[2, "village"] == ("corrected", "Khagaul") and got[2, "ulpin"][0] == "invalid_shape"
    assert (3, "tehsil") not in got and got[3, "district"][0] in ("corrected", "suggested", "not_found")
    assert correction.correct_record(r.limit(0), admin).count() == 0


def test_matching_in_a_scope_against_all_names(spark):
    r = random.Random(5)
    names = ["".join(r.choice("abdeimnoprst") for _ in range(r.randint(4, 9))) for _ in range(40)]
    values = [n[: k % 9] + r.choice("abd") + n[k % 9 :] for k, n in enumerate(names)] + names[:5]
    v = spark.createDataFrame(list(enumerate(values)), "id long, value string").withColumn("s", F.lit("x"))
    c = spark.createDataFrame([(n, "x") for n in names], "name string, s string")
    got = {x.id: (x.outcome, x.new_value) for x in correction.match_distinct(v, c, "village", ["s"]).collect()}
    for k, value in enumerate(values):
        best = sorted(((round(indel(value, n), 6), n) for n in names), key=lambda x: (-x[0], x[1]))
        if value in names:
            assert got[k] == ("confirmed", value)
        elif best[0][0] < 80:
            assert got[k][0] == "not_found"
        elif best[0][0] - best[1][0] <= 3 and best[1][0] > 0:
            assert got[k] == ("ambiguous", value)
        else:
            assert got[k] == (("corrected", best[0][1]) if best[0][0] >= 92 else ("suggested", value))


def test_a_document_from_lines_to_a_decision(spark, admin):
    lines = ["Khasra No : 213/1", "Khata No : 00620", "Owner Name : Shri Ram Prasad", "Plot Area : 0.4820", "Hectare", "Village :", "-", "Nigohan", "Tehsil : Mohanlalganj", "District : Lucknou", "land of Village Nigohan of District Lucknow"]
    df = spark.createDataFrame([(7, k, x, 0.97) for k, x in enumerate(lines)] + [(8, 0, "nothing to read", 0.5)], "doc long, line_no int, text string, ocr double")
    got = {r.id: r for r in process.process(df, admin, "2024-01-01").collect()}
    r = got[7]
    assert (r.khasra_number, r.owner_name, r.area, r.village, r.district, r.state) == ("213/1", "Ram Prasad", "0.4820 hectare", "Nigohan", "Lucknow", "Uttar Pradesh")
    found = {(i.rule, i.field) for i in r.issues}
    assert ("VOCAB_CORRECTED", "district") in found and ("DOCUMENT_TYPE", None) in found and r.error_count == 0
    assert got[8].decision == "blocked" and got[8].khasra_number is None
    again = process.process(df.where("doc = 7").withColumn("doc", F.lit(9).cast("long")), admin, "2024-01-01", existing=process.process(df, admin, "2024-01-01")).collect()
    assert [i.rule for i in again[0].issues if i.rule == "DUPLICATE"] == ["DUPLICATE"] and again[0].decision == "needs_review"


def test_edits_are_certain_when_validated_again(spark, admin):
    flat = record(spark, {"khasra_number": "1/2", "khata_number": "3", "owner_name": "Ram Prasad", "area": "2 hectare", "village": "Nigohan", "district": "Nowhere"})
    edits = spark.createDataFrame([(0, "district", "Patna", False, 1), (0, "district", "Lucknow", False, 2)], "document_id long, field_key string, new_value string, confirm_only boolean, seq long")
    (r,) = process.revalidate(flat, edits, lambda k: F.lit(0.9), "2024-01-01", admin).collect()
    assert r.district == "Lucknow" and "DISTRICT_UNKNOWN" not in {i.rule for i in r.issues} and r.error_count == 0


def test_labels_in_other_scripts_units_and_sentences(spark):
    lines = ["মালিকের নাম : করিম শেখ", "ਪਿੰਡ : ਰਾਮਪੁਰ", "Total Area : 0.4820", "x", "Hectare only", "the owner of the said land in the village which is bounded by the road"]
    df = spark.createDataFrame([(1, k, x, 0.9) for k, x in enumerate(lines)], "doc long, line_no int, text string, ocr double")
    got = {r.field_key: r for r in extraction.extract_fields(df).collect()}
    assert got["owner_name"].value == "করিম শেখ" and got["village"].value == "ਰਾਮਪੁਰ" and got["area"].value == "0.4820 hectare"
    assert got["owner_name"].confidence > extraction.PROSE_CAP
    prose = {r.field_key: r for r in extraction.extract_fields(df.where("line_no = 5")).collect()}
    assert all(r.confidence <= extraction.PROSE_CAP and r.status != "extracted" for r in prose.values())


def test_a_rule_that_cannot_run_is_an_issue(spark, admin):
    flat = record(spark, {"khasra_number": "1/2"})
    v = rules.validate(flat.withColumn("share", F.array(F.lit(1))), lambda k: F.lit(0.9), "2024-01-01", admin)
    assert "RULE_ERROR" in {i.rule for i in v.first().issues}


def test_best_match_against_all_rows(spark):
    r = random.Random(3)
    parcel = lambda k: (f"{r.randint(1, 400)}/{r.randint(1, 9)}", str(r.randint(1, 3000)), f"village {r.randint(1, 60)}", r.choice(["Patna", "Lucknow", "Gaya"]))
    reg = [(f"R{k:03}", *parcel(k)) for k in range(80)]
    rec = [(k, *(reg[k][1:] if k % 3 else parcel(k))) for k in range(60)]
    cols = "khasra_number string, khata_number string, village string, district string"
    g = spark.createDataFrame(reg, "source_id string, " + cols)
    q = spark.createDataFrame(rec, "id long, " + cols)
    pruned = {x.id: (x.source_id, round(x.score, 9)) for x in registry.best_match(q, g).collect()}
    whole = {x.id: (x.source_id, round(x.score, 9)) for x in registry.best_match(q, g, least=0.0001).collect()}
    assert pruned == {k: v for k, v in whole.items() if v[1] >= registry.MATCH} and len(pruned) > 20


IDS = "khasra_number string, khata_number string, village string, district string"


def nearest(records, registry_rows, least):
    """Source and score by n-gram counts in plain Python, every record against every registry row."""

    def counts(row):
        words = [f" {re.sub('[^a-z0-9]', '', (x or '').lower())} " for x in row]
        return Counter(w[i : i + n] for w in words if w != "  " for n in (2, 3) for i in range(max(len(w) - n + 1, 1)))

    docs = sorted((s, counts(x)) for s, *x in registry_rows)
    df = Counter(g for _, d in docs for g in d)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}
    length = lambda d: math.sqrt(sum((n * idf[g]) ** 2 for g, n in d.items() if g in idf))
    out = {}
    for k, *x in records:
        q = counts(x)
        scores = [(-round(sum(n * d[g] * idf[g] ** 2 for g, n in q.items() if g in d) / (length(q) * length(d)), 9), s) for s, d in docs if length(d) and length(q)]
        if scores and -min(scores)[0] >= max(least, 1e-9):
            out[k] = (min(scores)[1], -min(scores)[0])
    return out


@pytest.mark.parametrize("block", [7, 32768])
def test_best_match_in_blocks_with_copies_ties_and_gaps(spark, monkeypatch, block):
    monkeypatch.setattr(registry, "BLOCK", block)
    monkeypatch.setattr(registry, "TEXTS", 9)
    r = random.Random(11)
    parcel = lambda: (f"{r.randint(1, 40)}/{r.randint(1, 3)}", r.choice(["", None, str(r.randint(1, 30))]), f"village {r.randint(1, 4)}", r.choice(["Patna", "Gaya", None]))
    reg = [(f"R{k}", *parcel()) for k in range(60)]
    reg += [("R9x", *reg[5][1:]), ("R00", *reg[5][1:]), ("R61", None, None, "", None), ("R62", "12", "21", "x", "y"), ("R63", "21", "12", "x", "y")]
    rec = [(k, *parcel()) for k in range(80)] + [(80, *reg[5][1:]), (81, None, "", "--", None), (82, "zz", "zz", "zz", "zz"), (83, "12", "21", "x", "y"), (84, *reg[9][1:]), (85, *reg[9][1:])]
    g, q = spark.createDataFrame(reg, "source_id string, " + IDS), spark.createDataFrame(rec, "id long, " + IDS)
    for least in (registry.MATCH, 0.0):
        got = {x.id: (x.source_id, round(x.score, 9)) for x in registry.best_match(q, g, least=least).collect()}
        want = nearest(rec, reg, least)
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 2e-9 for k in want)
    assert got[80][0] == "R00" and got[83][0] == "R62" and got[84] == got[85] and not {81, 82} & got.keys()
    assert registry.best_match(q, g.limit(0)).count() == 0 and registry.best_match(q.limit(0), g).count() == 0


def test_best_match_writes_no_pairs(spark):
    """No step of the plan gives out a row for each pair of records and registry rows that share an n-gram."""
    r = random.Random(5)
    parcel = lambda: (f"{r.randint(1, 900)}/{r.randint(1, 9)}", str(r.randint(1, 3000)), "village 1", "Patna")
    n = 400
    g = spark.createDataFrame([(k, *parcel()) for k in range(n)], "source_id long, " + IDS)
    found = registry.best_match(spark.createDataFrame([(k, *parcel()) for k in range(n)], "id long, " + IDS), g)
    assert found.collect()

    def most(plan) -> int:
        name = plan.getClass().getSimpleName()
        inner = "executedPlan" if name == "AdaptiveSparkPlanExec" else "plan" if name.endswith("QueryStageExec") else None
        rows, below = plan.metrics().get("numOutputRows"), plan.children()
        kids = [getattr(plan, inner)()] if inner else [below.apply(k) for k in range(below.size())]
        return max([rows.get().value() if rows.isDefined() else 0, *map(most, kids)])

    assert 0 < most(found._jdf.queryExecution().executedPlan()) < n * n / 2


def test_scores_of_a_block_do_not_depend_on_what_was_kept(monkeypatch):
    r = random.Random(7)
    texts = [f"{r.randint(1, 99)} {r.randint(1, 99)} village{r.randint(1, 5)}" for _ in range(50)]
    weights = {g: 1 + r.random() for x in texts for w in (f" {y} " for y in x.split()) for n in (2, 3) for g in (w[i : i + n] for i in range(len(w) - n + 1))}
    asked = sorted(texts[:20] + ["", "77 village9", "8 8 8", "8 8", "none"])
    wide = registry.Block(weights, texts)
    kept = [wide.best(x, 0.2) for x in asked]
    monkeypatch.setattr(registry, "KEPT", -1)
    r.shuffle(order := list(range(len(asked))))
    bare = registry.Block(weights, texts)
    assert {k: bare.best(asked[k], 0.2) for k in order} == dict(enumerate(kept))
    assert kept[asked.index("")] == (None, 0.0) and kept[asked.index(texts[3])][1] == pytest.approx(1.0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_common_area_against_samples(seed):
    """Star-shaped rings, some concave, against counting points of a grid."""
    r = random.Random(seed)

    def ring():
        n, x, y = r.randint(3, 8), r.uniform(-1, 1), r.uniform(-1, 1)
        turn = [2 * math.pi * k / n for k in range(n)]
        out = [{"x": x + d * math.cos(t), "y": y + d * math.sin(t)} for t in turn for d in [r.uniform(0.4, 2)]]
        return out if r.random() < 0.5 else out[::-1]

    def inside(x, y, p):
        odd = False
        for a, b in zip(p, p[1:] + p[:1]):
            if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                odd = not odd
        return odd

    a, b = ring(), ring()
    step = 0.08
    spots = [(-3 + step * (i + 0.5), -3 + step * (j + 0.5)) for i in range(75) for j in range(75)]
    want = sum(inside(x, y, a) and inside(x, y, b) for x, y in spots) * step * step
    assert abs(topology.common_area(a, b) - want) < 0.25
    assert abs(topology.common_area(a, a) - abs(sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(a, a[1:] + a[:1])) / 2)) < 1e-9


def test_vocabulary_issues_have_a_weight():
    assert set(enrichment.VOCABULARY.values()) == {"info", "warning"}


def test_nested_boxes_against_all_pairs_and_many_at_once():
    import time

    r = random.Random(4)
    for _ in range(150):
        boxes = []
        for n in range(60):
            x, y, w, h = (round(r.uniform(-4, 4), 1) for _ in range(4))
            boxes.append((n, x, y, x + (w if r.random() < 0.1 else abs(w) * r.choice((0, 0.1, 1, 9))), y + abs(h)))
        boxes.sort(key=lambda b: (-(b[3] - b[1]) * (b[4] - b[2]), b[0]))
        kept: list = []
        for b in boxes:
            inside = (max(0.0, min(b[3], k[3]) - max(b[1], k[1])) * max(0.0, min(b[4], k[4]) - max(b[2], k[2])) for k in kept)
            if not any(i > 0.8 * (b[3] - b[1]) * (b[4] - b[2]) for i in inside):
                kept.append(b)
        assert scans._kept_boxes(boxes) == [k[0] for k in kept]
    start = time.monotonic()
    assert len(scans._kept_boxes((n, n % 200, n // 200, n % 200 + 1, n // 200 + 1) for n in range(20_000))) == 20_000
    assert time.monotonic() - start < 5


def test_rows_of_a_page_against_all_rows():
    r = random.Random(6)
    for _ in range(300):
        page = []
        for n in range(r.randint(1, 80)):
            y = r.uniform(0, 60)
            page.append([r.uniform(0, 9), y, y + r.choice((0.2, 1, 3, 30)) * r.choice((1, 1, 1, 1, -1 if r.random() < 0.02 else 1)), f"w{n}"])
        page.sort(key=lambda f: (round(f[1], 1), f[0], f[3]))
        rows: list = []
        for f in page:
            for row in rows:
                a = row[0]
                if abs((f[1] + f[2]) - (a[1] + a[2])) / 2 <= max(1.0, min(f[2] - f[1], a[2] - a[1])) * 0.55:
                    row.append(f)
                    break
            else:
                rows.append([f])
        assert scans._rows_of(page) == [" ".join(f[3] for f in sorted(row, key=lambda f: f[0])) for row in rows]


def test_pages_stream_without_a_frame_each(spark):
    words = spark.range(20_000).selectExpr("id div 4 AS page", "CAST(id % 2 AS DOUBLE) AS x0", "(id div 2) % 2 * 12.0 AS y0", "id % 2 + 1.0 AS x1", "(id div 2) % 2 * 12.0 + 10 AS y1", "concat('w', id) AS text")
    words = words.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS page, 0D AS x0, 0D AS y0, 1D AS x1, 9D AS y1, CAST(NULL AS STRING) AS text"))
    df = scans.visual_rows(words, "page")
    got = {(x.page, x.line_no): x.text for x in df.collect()}
    assert got == {(k // 2, k % 2): f"w{2 * k} w{2 * k + 1}" for k in range(10_000)} | {(None, 0): ""}
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()


def test_digits_meet_by_place_and_as_all_pairs_would(spark):
    r = random.Random(8)

    def line(n):
        y, h, x = r.uniform(-40, 40), r.choice((1, 2, 3.7, 8, 30)), r.uniform(0, 20)
        return (r.randint(1, 2), n, x, y, x + 60, y + h, " ".join(["k", *(str(r.randint(1, 99)) for _ in range(r.randint(0, 2)))]))

    a, b = [[line(n) for n in range(150)] for _ in range(2)]
    schema = "page long, line_no long, x0 double, y0 double, x1 double, y1 double, text string"
    df = scans.repair_digits(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    got = {(x.page, x.line_no): x.text for x in df.collect()}
    want = {}
    for p in a:
        fit = []
        for d in b:
            tall = (min(p[5], d[5]) - max(p[3], d[3])) / min(p[5] - p[3], d[5] - d[3])
            wide = max(0.0, min(p[4], d[4]) - max(p[2], d[2])) / (max(p[4], d[4]) - min(p[2], d[2]))
            n = len(p[6].split()) - 1
            if d[0] == p[0] and tall >= 0.6 and wide >= 0.5 and n and n == len(d[6].split()) - 1:
                fit.append((-tall, d[1], d[6]))
        want[p[0], p[1]] = min(fit)[2] if fit else p[6]
    assert got == want and got != {(p[0], p[1]): p[6] for p in a}
    assert "cell" in df._jdf.queryExecution().optimizedPlan().toString()
