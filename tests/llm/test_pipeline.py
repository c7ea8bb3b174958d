"""The pipeline's stages against brute force on a small corpus."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plotwright.llm import decontaminate, toxicity
from plotwright.llm.common import table
from tests.llm.test_operators import SF, WORDS, brute_components, brute_dedup, naive_tiles


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe_codec"]


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, table(spark, SF, "labels"))
    mild = {r.doc_id for r in toxicity.scores(docs, model).where("predicted = 0").collect()}
    texts = {i: t for i, t in sorted(rows.items()) if i in mild}
    after = {}
    for (i, t), gone in zip(texts.items(), brute_dedup(list(texts.values())), strict=True):
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or WORDS.search(left):
            after[i] = left
    kept = [i for i, _, least in brute_components(list(after.values()), list(after)) if i == least]
    items = [decontaminate.words_of(r.text) for r in table(spark, SF, "benchmark").collect()]

    def leaks(text):
        words = decontaminate.words_of(text)
        for item in items:
            number = {w: n for n, w in enumerate(dict.fromkeys(item))}
            doc = [number.get(w, -1) for w in words]
            grams = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
            if any(tuple(number[w] for w in item[k : k + 5]) in grams for k in range(len(item) - 4)) and 2 * sum(x[0] for x in naive_tiles([number[w] for w in item], doc, 5)) >= len(item):
                return True
        return False

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: tok.encode(after[i], add_special_tokens=False).ids for i in kept if not leaks(after[i])}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_awkward_rows(spark):
    from tests.llm.test_operators import DOCS, ODD

    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "same words here and there", "en", "s", 1)] * 2 + [(3, "one", "en", "s", 3)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS key", "'x' AS n_lines")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "n_lines"], name
    left = docs.collect()
    assert {None, 3} <= {r.doc_id for r in left} and sum(r.text == "a b c" for r in left) == 1
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(coded) == len(left)


def test_stages_on_empty_tables(spark):
    from tests.llm.test_operators import DOCS

    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_near_duplicates_go_by_row(spark):
    from tests.llm.test_operators import DOCS

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    texts = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (None, d), (None, d), (None, c), (4, None), (4, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS).selectExpr("*", "1 AS key", "2 AS root")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(1, a), (2, b), (3, c), (None, d), (4, None), (4, None), (None, "")], key=repr)
    one_each = docs.where("doc_id < 3")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, one_each, SF).collect()) == [(1, a), (2, b)]
