"""Personal data spans by weak supervision, with DataFrame functions only.

Patterns propose spans. Those of the four base kinds always count; the others are candidates. Three
sorts of labelers vote on every span (for, against, or not at all): shape (regular expressions
and checksums), gazetteers (known endings and prefixes) and context (words before the span, and
its edges). Expectation-maximisation over the counts of vote patterns, which are few however large
the corpus, estimates how far each labeler can be trusted; a logistic classifier is trained on the
posteriors and decides the candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: In the order of the span list.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "name")
# Possessive, and tied to the start of a run or the end of the last match: the same leftmost matches in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Runs of fewer than 12 digits fail in any case.
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates: kind, pattern, and a plain string or pattern that a text must have.
LOOSE = (
    ("email", r"[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\))\x20?|\.)[A-Za-z0-9-]++)++", "at"),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", None),
    ("secret", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", "AKIA"),
    ("secret", r"(?i)(?<![a-z])(?:password|passwd|token|secret|api_?key)\x20?[=:]\x20?\"?[A-Za-z0-9_+/-]{8,}+\"?", None),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr)\.\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?", ". "),
)
#: Gazetteers (endings of domains, calling codes, common names) and cue words, fixed lists.
KNOWN = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|biz|io|app|dev|ai|co|me|eu|at|au|be|br|ca|ch|cn|cz|de|dk|es|fi|fr|gr|hu|ie|il|in|it|jp|kr|mx|nl|no|nz|pl|pt|ro|ru|se|sg|tr|tw|ua|uk|us|za)$",
    "ip": r"^(?:10|127|172|192)\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1236]|35[1-9]|37[0-9]|38[0-9]|42[01]|97[0-7])[^0-9]|\(?[2-9])",
    "secret": r"^AKIA|[0-9]",
    "ssn": r"^(?!000|666|9)",
    "name": r"(?i)\b(?:james|john|robert|michael|william|david|richard|joseph|thomas|charles|mary|patricia|jennifer|linda|elizabeth|barbara|susan|jessica|sarah|karen|jane|anna|peter|paul|george|daniel|mark|laura|emma|alice|hans|karl|klaus|ursula|monika|pierre|jean|marie|claire|luc|jose|juan|carlos|maria|carmen|ana|luis|smith|johnson|williams|brown|jones|davis|miller|wilson|moore|taylor|anderson|jackson|white|harris|clark|lewis|walker|hall|young|king|wright|green|baker|mueller|schmidt|schneider|fischer|weber|meyer|wagner|becker|hoffmann|martin|bernard|dubois|durand|moreau|garcia|lopez|gonzalez|rodriguez|fernandez|martinez|sanchez|perez)\b",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|mailto|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|from)",
    "card": r"(?i)(?:card|visa|mastercard|amex|payment|karte|tarjeta|carte)",
    "phone": r"(?i)(?:phone|tel\b|call|fax|mobile|telefon|tel[eé]fono|t[eé]l)",
    "secret": r"(?i)(?:key|password|token|secret|aws)",
    "ssn": r"(?i)(?:ssn|social)",
    "name": r"(?i)(?:name|dear|contact|from|by)",
}
AGAINST = r"(?i)(?:version|license|isbn|chapter|section|figure|art\.|§)\W{0,4}$"
CONTEXT = 40
#: Votes: 1 for, 0 against, -1 none.
VOTES = ("shape", "known", "cue", "against", "edges")
ROUNDS, STEPS, RATE = 60, 400, 0.5


def _let(value: Column, body) -> Column:
    """`body` over a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Matches that are placed at a time: an array grows by copying, so long ones are made of short ones.
PLACED = 64


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit, before, after>> of a pattern's matches, leftmost and without overlap, in code points.

    `before` has up to CONTEXT characters, from after the match before the last one; `after` has one.
    """
    kind = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    empty = F.lit("")

    def placed(cut: Column) -> Column:
        gap, hit = (lambda i: F.coalesce(F.get(cut["gaps"], i), empty)), (lambda i: F.coalesce(F.get(cut["hits"], i), empty))

        def one(x: Column, i: Column) -> Column:
            before = F.right(F.concat(gap(i - 1), hit(i - 1), gap(i)), F.lit(CONTEXT))
            return F.struct(F.length(gap(i)).alias("gap"), x.alias("hit"), before.alias("before"), F.left(F.concat(gap(i + 1), hit(i + 1)), F.lit(1)).alias("after"))

        return F.transform(cut["hits"], one)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def runs(found: Column) -> Column:
        last = F.floor((F.size(found) - 1) / PLACED).cast("int")
        return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.aggregate(F.slice(found, i * PLACED + 1, PLACED), zero, step)))

    def moved(done: Column) -> Column:
        begin = F.aggregate(done, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(done, begin, lambda r, o: F.transform(r["out"], lambda x: F.struct((x["start"] + o).alias("start"), (x["end"] + o).alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after")))))

    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.coalesce(_let(_let(_let(cut, placed), runs), lambda done: F.when(done.isNotNull(), moved(done))), F.array().cast(kind))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """The check that a base match must pass; a match that fails is dropped."""
    if kind == "ip":
        octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    if kind == "card":
        n = F.length(_digits(hit))
        return (n >= 12) & (n <= 19) & luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,end:int,kind:int,base:boolean,hit:string,before:string,after:string>>"


def _found(text: Column, kind: str, pattern: str, base: bool, needed: Column) -> Column:
    found = F.filter(_spans(text, pattern), lambda x: _valid(kind, x["hit"]) if base else F.lit(True))
    tagged = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), *[x[c].alias(c) for c in ("hit", "before", "after")]))
    return F.coalesce(F.when(needed, tagged.cast(SPAN)), F.array().cast(SPAN))


def _by_kind(table: dict[str, str], kind: Column, value: Column) -> Column:
    out = F.lit(False)
    for name, pattern in table.items():
        out = F.when(kind == KINDS.index(name), value.rlike(pattern)).otherwise(out)
    return out


def _voted(x: Column) -> Column:
    before, after = x["before"], x["after"]
    one, zero, none = F.lit(1), F.lit(0), F.lit(-1)
    length = F.length(x["hit"])
    shape = F.when(x["base"], one).when((length >= 7) & (length <= 80), one).otherwise(zero)
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"),
        shape.alias("shape"),
        F.when(_by_kind(KNOWN, x["kind"], x["hit"]), one).otherwise(none).alias("known"),
        F.when(_by_kind(CUES, x["kind"], F.concat(before, F.lit(" "), F.when(x["kind"] == KINDS.index("secret"), x["hit"]).otherwise(F.lit("")))), one).otherwise(none).alias("cue"),
        F.when(before.rlike(AGAINST), zero).otherwise(none).alias("against"),
        F.when(before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]"), zero).otherwise(one).alias("edges"),
    )


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and spans: base spans and candidates of every row, with the labelers' votes."""
    t = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(
        _found(text, "email", EMAIL, True, F.contains(text, F.lit("@"))),
        _found(text, "ip", IP, True, text.rlike(r"[0-9]\.[0-9]")),
        _found(text, "card", CARD, True, text.rlike(CARD)),
        _found(text, "phone", PHONE, True, F.contains(text, F.lit("+"))),
    )
    loose = F.concat(*[_found(text, kind, pattern, False, text.rlike(pattern) if need is None else F.contains(text, F.lit(need))) for kind, pattern, need in LOOSE])
    t = t.withColumn("base", base).withColumn("loose", loose)
    apart = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return t.select("doc_id", F.transform(F.concat("base", apart), _voted).alias("spans"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[list[float], list[tuple[float, float]], float]:
    """Expectation-maximisation over (votes, number of spans): posteriors, reliabilities, share of true spans.

    A reliability is (chance to vote for a true span, chance to vote for a false one), smoothed; a
    labeler that does not vote says nothing. Without patterns the start values come back.
    """
    n = len(patterns[0][0]) if patterns else len(VOTES)
    rel, prior = [(0.8, 0.3)] * n, 0.6
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for votes, _ in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for v, (p, q) in zip(votes, rel, strict=True):
                if v >= 0:
                    a += math.log(p if v else 1 - p)
                    b += math.log(q if v else 1 - q)
            post.append(1 / (1 + math.exp(min(700.0, b - a))))
        total = sum(c for _, c in patterns)
        prior = min(0.99, max(0.01, (sum(x * c for x, (_, c) in zip(post, patterns, strict=True)) + 1) / (total + 2)))
        rel = []
        for k in range(n):
            cast = [(v[k], x, c) for x, (v, c) in zip(post, patterns, strict=True) if v[k] >= 0]
            # prior counts hold the labelers to being better than chance
            p = (sum(x * c for v, x, c in cast if v) + 8) / (sum(x * c for _, x, c in cast) + 10)
            q = (sum((1 - x) * c for v, x, c in cast if v) + 3) / (sum((1 - x) * c for _, x, c in cast) + 10)
            rel.append((min(0.99, p), max(0.01, min(q, p))))
    return post, rel, prior


def features(votes: tuple[int, ...], kind: int) -> list[float]:
    return [1.0, *(float(v) if v >= 0 else 0.5 for v in votes), *(1.0 if kind == k else 0.0 for k in range(len(KINDS)))]


def train(rows: list[tuple[int, tuple[int, ...], int]], post: list[float], steps: int = STEPS) -> list[float]:
    """Weights of the span classifier: logistic regression on the posteriors, each pattern by its count."""
    w = [0.0] * (1 + len(VOTES) + len(KINDS))
    weight = [math.log1p(c) for _, _, c in rows]
    total = sum(weight) or 1.0
    x = [features(v, k) for k, v, _ in rows]
    for _ in range(steps):
        grad = [1e-3 * v for v in w]
        for row, y, c in zip(x, post, weight, strict=True):
            z = sum(a * b for a, b in zip(w, row, strict=True))
            err = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * c / total
            for i, a in enumerate(row):
                grad[i] += err * a
        w = [a - RATE * g for a, g in zip(w, grad, strict=True)]
    return w


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (start, end in code points, kind, base, score) of every row, sorted.

    Base spans are kept whatever the classifier says; a candidate is kept if it overlaps no base span
    and the classifier gives it a half or more. Spans go by start, then by kind as KINDS lists them.
    A null or empty text has no spans; a null id stays null; repeated rows each give a row; other
    columns are not read; an empty table gives an empty result.
    """
    found = cut(candidates(docs, id_col, text_col))
    seen = found.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{c}").alias(c) for c in ("kind", *VOTES)]).agg(F.count("*").alias("n"))
    # at most kinds x 3 ** labelers rows, whatever the corpus
    rows = sorted((r["kind"], tuple(r[v] for v in VOTES), r["n"]) for r in seen.collect())
    post, _, _ = estimate([(v, n) for _, v, n in rows])
    w = train(rows, post)

    def score(x: Column) -> Column:
        z = F.lit(w[0])
        for i, v in enumerate(VOTES):
            z = z + F.when(x[v] >= 0, x[v].cast("double")).otherwise(0.5) * w[1 + i]
        for k in range(len(KINDS)):
            z = z + F.when(x["kind"] == k, w[1 + len(VOTES) + k]).otherwise(0.0)
        return F.lit(1.0) / (F.exp(-z) + 1.0)

    scored = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("no"), x["end"].alias("end"), x["base"].alias("base"), score(x).alias("score")))
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.array_sort(F.filter(scored, lambda x: x["base"] | (x["score"] >= 0.5)))
    return found.select("doc_id", F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["no"]).alias("kind"), x["base"].alias("base"), x["score"].alias("score"))).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Numbers of base spans, the digest of the base spans, and all spans as kind:start:end."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
