"""Quality rules as a short-circuit cascade.

Every row gets the base measures. The further rules are tried one after another until one rejects
the text; their order comes from a bounded sample, on which each rule's cost and rejection rate are
measured: the rule that rejects most per second goes first. A text is kept if no rule rejects it,
so the order changes the time, never the verdict.
"""

from __future__ import annotations

import operator
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS, UPPER, LOWER, DIGITS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
WINDOW, LEAST_WORDS = 8, 20
#: Rows of the sample on which the cascade is ordered.
SAMPLE_ROWS = 400
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words that lie in `width`-word windows found twice or more; exact, by doubling window names."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[str, int] = {}
    name = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    known, size = len(number), 1
    while size < width:
        step = min(size, width - size)
        _, name, times = np.unique(name[:-step] * known + name[step:], return_inverse=True, return_counts=True)
        known, size = len(times), size + step
        if known == len(name):
            return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(times[name] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


class Text:
    """A text with the measures that rules share, each made when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.words = WORDS.findall(text)
        self.n_words = len(self.words)
        self.word_chars = sum(map(len, self.words))
        self.raw = text.encode("utf-8", "surrogatepass")
        self.n_symbols = self.count(SYMBOLS)

    def count(self, chars: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, chars))

    @cached_property
    def lines(self) -> Counter:
        return Counter(line for line in self.text.split("\n") if WORDS.search(line))

    @cached_property
    def n_dup_lines(self) -> int:
        return self.lines.total() - len(self.lines)

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > 30 * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Integer arithmetic only, so that SQL says the same.
RULES = (
    Rule("symbols over a tenth of the words", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("mean word under 2 or over 15 characters", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("more capital than small A-Z", lambda t: t.count(UPPER) > t.count(LOWER) and t.count(UPPER) > 10),
    Rule("an exclamation mark for every two words", lambda t: 2 * t.count(b"!") > t.n_words),
    Rule("three tenths of the characters are digits", lambda t: 10 * t.count(DIGITS) > 3 * t.word_chars),
    Rule("a fifth of the words repeat the one before", lambda t: 5 * sum(map(operator.eq, t.words, t.words[1:])) > t.n_words),
    Rule("one word is three tenths of the words", lambda t: 10 * max(Counter(t.words).values(), default=0) > 3 * t.n_words),
    Rule("half of the lines are copies", lambda t: 2 * t.n_dup_lines > t.lines.total()),
)


def order_rules(texts: list[str], rules=RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a text, share rejected), most rejections per second first.

    Selectivity is conditional: after a rule is chosen, only the texts that pass it count for the
    rest. Rules that reject nothing in the sample go last, cheapest first.
    """
    left = [Text(t) for t in texts]
    for t in left:
        _ = t.n_dup_lines
    rest, out = list(rules), []
    while rest:
        tried = []
        for r in rest:
            began = time.perf_counter()
            hit = [r.rejects(t) for t in left]
            cost = (time.perf_counter() - began) / max(1, len(left)) + 1e-9
            tried.append((sum(hit) / max(1, len(left)) / cost, -cost, r, hit))
        gain, cost, rule, hit = max(tried, key=lambda x: x[:2])
        out.append((rule, -cost, sum(hit) / max(1, len(left))))
        rest.remove(rule)
        left = [t for t, h in zip(left, hit, strict=True) if not h]
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, rules=RULES) -> DataFrame:
    """The base measures of every row, base_failed, and kept: no base failure and no rule rejects.

    A null text has no words and fails the base. A null id stays null, repeated rows each give a
    row, an empty table an empty result; other columns are not read. The sample (at most
    `sample_rows` rows) only orders the rules.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sample = [r.text or "" for r in slim.limit(sample_rows).collect()]
    cascade = [rule.rejects for rule, _, _ in order_rules([t for t in sample if not Text(t).base_failed], rules)]

    def rows(batches):
        for b in batches:
            out = []
            for t in map(Text, (t or "" for t in b.column(1).to_pylist())):
                failed = t.base_failed
                out.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and not any(r(t) for r in cascade)))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split(" ")[0] for x in SCHEMA.split(", ")])

    return slim.mapInArrow(rows, SCHEMA)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM hit) GROUP BY rid),
ln AS (SELECT rid, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(str_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid),
top AS (SELECT rid, max(n) AS n FROM (SELECT rid, x, count(*) AS n FROM (SELECT rid, unnest(ws) AS x FROM w) GROUP BY rid, x) GROUP BY rid),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(ln.n_lines, 0) AS n_lines, coalesce(top.n, 0) AS top_n,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_excl, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
    len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_adjacent
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN top USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (n_upper > n_lower AND n_upper > 10)
    OR 2 * n_excl > n_words OR 10 * n_digits > 3 * word_chars OR 5 * n_adjacent > n_words OR 10 * top_n > 3 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""
