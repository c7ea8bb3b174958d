"""The parts that the operators share, against plain versions."""

import base64
import random
import time

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plotwright.llm import bpe, html_blocks, ngram_join, toxicity
from plotwright.llm.bpe import PairTable, merge
from plotwright.llm.common import join_hot, pack, unpack
from plotwright.llm.components import components
from plotwright.llm.token_counts import PieceCounter
from tests.llm.test_operators import WORDS


def test_pack_round_trip():
    arrays = [np.arange(5), np.empty(0, np.uint8), np.array([1.5, 2.5]), np.array([7], np.uint64)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def sequential(word, ranks):
    """Plain BPE: the lowest-rank pair, leftmost first, one at a time."""
    word = list(word)
    while True:
        found = [(ranks[p][0], i) for i in range(len(word) - 1) if (p := (word[i], word[i + 1])) in ranks]
        if not found:
            return word
        _, i = min(found)
        word[i : i + 2] = [ranks[(word[i], word[i + 1])][1]]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_merging_is_the_sequential_rule(seed):
    r = random.Random(seed)
    ranks, top = {}, 3
    order = list(range(40))
    r.shuffle(order)  # ranks in any order: a pair may outrank the one that makes its symbol
    for k in range(r.randint(0, 14)):
        pair = (r.randrange(top), r.randrange(top))
        if pair not in ranks:
            ranks[pair] = (order[k], top)
            top += 1
    table = PairTable([a for a, _ in ranks], [b for _, b in ranks], [v[0] for v in ranks.values()], [v[1] for v in ranks.values()], top)
    words = [[r.randrange(4) for _ in range(r.randint(0, 25))] for _ in range(12)]  # symbol 3 is unknown if nothing was made
    bpe.LONG, old = r.choice([1, 8, 1024]), bpe.LONG
    sym, left = merge(np.array([s for w in words for s in w], np.int64), np.array([len(w) for w in words]), table)
    bpe.LONG = old
    got, at = [], 0
    for n in left.tolist():
        got.append(sym[at : at + n].tolist())
        at += n
    assert got == [sequential(w, ranks) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAzZé \t\n\x0b中😀", max_size=40)), max_size=8), st.sampled_from([1, 7, 10**6]))
def test_word_hashes_follow_the_words(texts, size):
    old, ngram_join.CHUNK_BYTES = ngram_join.CHUNK_BYTES, size
    try:
        got = [s.tolist() for s in ngram_join.shingle_sets(pa.array(texts, pa.string()))]
    finally:
        ngram_join.CHUNK_BYTES = old
    low = [WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in low]
    assert [len(g) for g in got] == [len(s) for s in sets]
    for a, x in zip(got, sets, strict=True):
        for b, y in zip(got, sets, strict=True):
            assert len(set(a) & set(b)) == len(x & y)


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, k) for k in range(201, 240)] + [(None, 5), (9, 9)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    linked = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}


@pytest.mark.parametrize(("n_parts", "width"), [(1, 6), (256, 6), (257, 7), (65536, 7), (65537, 8)])
def test_names_of_all_parts_differ(n_parts, width):
    parts = np.unique([0, (n_parts - 1) % 256, n_parts - 1]).astype(np.uint64)
    token = parts << np.uint64(40) | np.uint64(12345)
    assert ngram_join._width(n_parts) == width
    assert ngram_join._wide(ngram_join._narrow(token, width), width).tolist() == token.tolist()


def test_windows_cover_each_word_once():
    texts = ["one two three four five six", "", "  a\tb ", "x" * 300]
    padded = [t + " " * toxicity.TAIL for t in texts]
    data = toxicity.lowered(np.frombuffer("".join(padded).encode(), np.uint8))
    at = np.cumsum([0] + [len(p) for p in padded])
    begin, size, row = toxicity.windows(data, at, 4)
    assert [(int(r), bytes(data[b : b + n]).decode().split()[:4]) for b, n, r in zip(begin, size, row)] == [(0, "one two three four".split()), (0, "five six".split()), (2, ["a", "b"]), (3, ["x" * 300])]


def test_blocks_of_awkward_pages():
    b = lambda h: [x.text for x in html_blocks.blocks(h)]
    assert b("") == [] and b("plain & text") == ["plain & text"]
    assert b("<p>a<p>b<ul><li>c<li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert b('<a title="x>y">t</a><br>u<!-- <p>no</p> --><script>var a="</p><p>";</script>v') == ["t uv"]
    assert b("<p>a &lt;b&gt; &eacute;&#8364;&nbsp;x\n\t y</p><style>p{}") == ["a <b> é€ x y"]
    assert html_blocks.blocks("<nav><ul><li><a href=x>m</a></ul></nav><p>t")[1].path == ("p",)


def test_block_vectors_see_all_words():
    start = "some words that stand in both of the blocks " * 12
    a, b, c = html_blocks.vectors([html_blocks.Block(start + end, ("p",)) for end in ("cookies", "article", "article")])
    words = slice(html_blocks.PATH_BINS, html_blocks.PATH_BINS + html_blocks.WORD_BINS)
    assert (a[words] != b[words]).any() and (b[words] == c[words]).all()
    assert np.abs(html_blocks.vectors([html_blocks.Block("word " * 9000, ("p",))])[0, words]).max() <= 1


def test_every_class_name_is_on_the_path():
    path = html_blocks.blocks('<div class="col-xs-12 col-sm-6 col-md-4 col-lg-3 px-2 sidebar">t</div>')[0].path
    assert path == ("div", ".col", ".xs", ".sm", ".md", ".lg", ".px", ".sidebar")


def test_a_text_without_spaces_takes_linear_time():
    counter = PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(7)
    for text in ("".join(r.choice("etaoins") for _ in range(30_000)), base64.b64encode(r.randbytes(20_000)).decode()):
        assert counter.count([text]) == [len(library.encode(text))]
    began = time.perf_counter()
    counter.count(["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))])
    assert time.perf_counter() - began < 60


def plain_groups(sizes, sets):
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (sizes[a] + sizes[b] - both):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6))
def test_candidate_groups_against_all_pairs(seed):
    r = np.random.default_rng(seed)
    base = [r.choice(60, r.integers(1, 25), replace=False) for _ in range(4)]
    sets = []
    for _ in range(20):
        kept = base[r.integers(4)][int(r.integers(0, 3)) :]
        sets.append(np.unique(np.concatenate([kept, r.integers(60, 90, r.integers(1, 3))])).astype(np.uint64))
    sizes = np.array([len(s) + int(r.integers(0, 2)) for s in sets])
    got = ngram_join.join_group(sizes, sets)
    least = [int(np.flatnonzero(got == x)[0]) for x in got]
    assert least == plain_groups(sizes.tolist(), [set(s.tolist()) for s in sets])


def test_unlinked_sets_cost_no_pairs():
    sets = [np.unique(np.append(1 + 20 * k + np.arange(20), 0)).astype(np.uint64) for k in range(40_000)]
    began = time.perf_counter()
    assert (ngram_join.join_group(np.full(len(sets), 21), sets) == np.arange(len(sets))).all()
    assert time.perf_counter() - began < 30


def test_hot_keys_are_joined_apart(spark):
    rows = spark.createDataFrame([(k % 3 if k < 900 else k, k) for k in range(1000)] + [(None, -1)], "a int, v int")
    small = spark.createDataFrame([(k, f"n{k}", 300 if k < 3 else 1) for k in range(950)], "a int, name string, times long")
    for how in ("inner", "left"):
        got = sorted(map(tuple, join_hot(rows, small, ["a"], "times", 1001, how).collect()), key=str)
        assert got == sorted(map(tuple, rows.join(small.drop("times"), "a", how).collect()), key=str)
