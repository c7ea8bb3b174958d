"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import DIGIT_ZEROS, SCRIPTS

_NATIVE = "".join(chr(z + d) for z in DIGIT_ZEROS for d in range(10))
_ASCII = "0123456789" * len(DIGIT_ZEROS)
_OCR = ("OoQDlI|!SsBZz", "0000111155822")


def fold_digits(c: Column) -> Column:
    """Digits of seven Indic scripts as ASCII digits."""
    return F.translate(c, _NATIVE, _ASCII)


def normalise(c: Column) -> Column:
    """ASCII digits, plain hyphens, colons and spaces; white space collapsed and trimmed. (For NFC see `similarity.nfc`.)"""
    c = F.translate(fold_digits(c), "‐‑‒–—―：;", "------::")
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def compare_key(c: Column) -> Column:
    """Comparison form: letters, digits and Devanagari only, lower case."""
    return F.regexp_replace(F.lower(normalise(c)), "[^a-z0-9ऀ-ॿ]", "")


def identifier_key(c: Column) -> Column:
    """A plot identifier reduced to ASCII letters and digits."""
    return F.regexp_replace(F.lower(fold_digits(F.coalesce(c, F.lit("")))), "[^0-9a-z]", "")


def detect_script(c: Column) -> Column:
    """The script most letters are in; `mixed` if it has under 55 % beside another, `unknown` without letters."""
    counts = {"latin": F.length(F.regexp_replace(c, "[^A-Za-z]", ""))}
    counts |= {name: F.length(F.regexp_replace(c, f"[^{chr(lo)}-{chr(hi)}]", "")) for name, lo, hi in SCRIPTS}
    total = sum(counts.values(), F.lit(0))
    top = F.greatest(*counts.values())
    kinds = sum((F.when(n > 0, 1).otherwise(0) for n in counts.values()), F.lit(0))
    name = F.coalesce(*[F.when(n == top, F.lit(k)) for k, n in counts.items()])
    return F.when(total == 0, "unknown").when((kinds > 1) & (top < total * 0.55), "mixed").otherwise(name)


def clean_number(c: Column) -> Column:
    """Digits with common misreadings repaired; a capital right after a digit and before no letter is kept as a subdivision."""
    chars = F.filter(F.split(fold_digits(c), ""), lambda x: x != "")
    n = F.size(chars)

    def one(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(chars, i - 1), F.lit(""))
        after = F.when(i + 1 < n, F.get(chars, i + 1)).otherwise("")
        kept = x.rlike("^[A-Z]$") & before.rlike("^[0-9]$") & ~after.rlike("^[A-Za-z]$")
        read = F.translate(x, *_OCR)
        return F.when(kept, x).when(read.rlike(r"^[0-9/.-]$"), read).otherwise("")

    return F.regexp_replace(F.array_join(F.transform(chars, one), ""), r"^[-/. ]+|[-/. ]+$", "")


def bigrams(c: Column) -> Column:
    """The distinct letter pairs of a string; a string of one letter is its own."""
    n = F.length(c)
    return F.when(n < 2, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the letter pairs: 1 for equal strings, 0 if one is empty."""
    x, y = bigrams(a), bigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def fold_roman(c: Column, collapse_doubles: bool = False) -> Column:
    """Romanised names up to the spellings they vary by. Doubled letters stay unless asked for."""
    c = F.replace(F.replace(F.lower(c), F.lit("au"), F.lit("o")), F.lit("ai"), F.lit("e"))
    c = F.regexp_replace(c, "[^a-z]", "")
    for a, b in (("w", "v"), ("q", "k"), ("x", "ks"), ("oo", "u"), ("ee", "i")):
        c = F.replace(c, F.lit(a), F.lit(b))
    if collapse_doubles:
        c = F.regexp_replace(c, r"(.)\1+", "$1")
    return F.regexp_replace(c, "a$", "")


def skeleton(key: Column) -> Column:
    """A phonetic key without its vowels, null if nothing is left."""
    return F.nullif(F.regexp_replace(key, "[aeiou]", ""), F.lit(""))


def fold_vowel_runs(c: Column) -> Column:
    """Lower case, with runs of one vowel collapsed."""
    return F.regexp_replace(F.lower(c), r"([aeiou])\1+", "$1")


def word_ngrams(words: Column, n: int) -> Column:
    """All runs of n words joined by spaces; none if there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def grounded(value: Column, source: Column) -> Column:
    """Whether a value stands in a text, white space, zero-width marks, case and digit scripts apart."""

    def flat(c: Column) -> Column:
        return F.regexp_replace(F.lower(fold_digits(F.coalesce(c, F.lit("")))), r"[\s ​-‍﻿]", "")

    return (flat(value) != "") & F.contains(flat(source), flat(value))


# First and last letter of the Indic blocks with the language that each is sent as.
INDIC = (("ऀ", "ॿ", "hi"), ("ঀ", "\u09ff", "bn"), ("\u0a00", "\u0a7f", "pa"), ("\u0a80", "\u0aff", "gu"), ("\u0b00", "\u0b7f", "or"), ("\u0b80", "\u0bff", "ta"), ("\u0c00", "\u0c7f", "te"), ("\u0c80", "\u0cff", "kn"), ("\u0d00", "\u0d7f", "ml"))


def script_language(c: Column) -> Column:
    """The language of the first Indic letter, null for text without one."""
    first = F.nullif(F.regexp_extract(c, f"[{INDIC[0][0]}-{INDIC[-1][1]}]", 0), F.lit(""))
    out = F.lit(None).cast("string")
    for low, high, language in INDIC:
        out = F.when(first.between(low, high), language).otherwise(out)
    return out


def is_indic(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{INDIC[0][0]}-{INDIC[-1][1]}]"), F.lit(False))


def label_order(label: Column) -> Column:
    """A sort key for plot labels: the number before the first slash (0 if it is none), then the label."""
    head = F.substring_index(label, "/", 1)
    return F.struct(F.when(head.rlike("^[0-9]+$"), head.cast("long")).otherwise(0).alias("number"), label.alias("label"))


def digit_skeleton(c: Column) -> Column:
    """A line with every run of digits as one #."""
    return F.regexp_replace(c, "[0-9]+", "#")


def looks_like_placeholder(c: Column, words: tuple[str, ...]) -> Column:
    return F.trim(F.regexp_replace(F.lower(normalise(F.coalesce(c, F.lit("")))), "[^a-z0-9/. ]", "")).isin(*words)
