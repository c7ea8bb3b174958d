"""Dates, areas and shares read from text, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let
from .text import normalise
from .vocab import ENGLISH_MONTHS, HINDI_MONTHS, REGIONAL, SPELLINGS, SQM


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0"))


def _groups(c: Column, pattern: str) -> list[Column]:
    return [F.regexp_extract(c, pattern, k) for k in (1, 2, 3)]


DAY_FIRST, YEAR_FIRST = r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})\b", r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
HINDI = rf"(\d{{1,2}})\s*({'|'.join(n for n, _ in HINDI_MONTHS)})\s*(\d{{4}})"
ENGLISH = r"(\d{1,2})\s*([A-Za-z]{3,9})\.?\s*(\d{4})"


def parse_date(raw: Column) -> Column:
    """ISO text of a date written day first, ISO, or with a Hindi or English month; null if none is read.

    Two-digit years up to 30 are 20xx, else 19xx; day and month are swapped if only that makes sense.
    Days run to 31 in every month: a date that does not exist is left for the rules to reject.
    """

    def read(t: Column) -> Column:
        d, m, y = (g.try_cast("int") for g in _groups(t, DAY_FIRST))
        year = F.when(y < 100, y + F.when(y <= 30, 2000).otherwise(1900)).otherwise(y)
        swap = (m > 12) & (d <= 12)
        day, month = F.when(swap, m).otherwise(d), F.when(swap, d).otherwise(m)
        first = F.when(month.between(1, 12) & day.between(1, 31), _iso(year, month, day))
        iy, im, idd = (g.try_cast("int") for g in _groups(t, YEAR_FIRST))
        second = F.when(im.between(1, 12) & idd.between(1, 31), _iso(iy, im, idd))
        hd, hm, hy = _groups(t, HINDI)
        third = F.when(hm != "", _iso(hy, F.create_map(*[x for n, k in HINDI_MONTHS for x in (F.lit(n), F.lit(k))])[hm], hd))
        ed, em, ey = _groups(t, ENGLISH)
        at = F.array_position(F.array(*[F.lit(x) for x in ENGLISH_MONTHS]), F.lower(F.substr(em, F.lit(1), F.lit(3))))
        last = F.when(at > 0, _iso(ey, at, ed))
        return F.when(F.coalesce((d > 31) & (m <= 12), F.lit(False)), None).otherwise(F.coalesce(first, second, third, last))

    return let(normalise(raw), read)


_NEXT = r"(?![\wऀ-෿])"
AREA_UNIT = "|".join(re.escape(s).replace(r"\ ", " ") for s, _ in SPELLINGS)
_PART, _FAR = rf"\d+(?:\.\d+)?\s*(?:{AREA_UNIT}){_NEXT}", rf"(\d+(?:\.\d+)?)\s+[a-z]{{1,4}}\.?\s+({AREA_UNIT}){_NEXT}"


def parse_area(raw: Column) -> Column:
    """struct<sqm, unit, regional_unit, unit_missing> of an area; null if the text has no number.

    One pattern takes the longest spelling of a unit at each place. Parts are summed (2 bigha 10 biswa).
    If no number has a unit right after it, one short word between number and unit is allowed; failing
    that, the unit is missing and sqm is null.
    """
    names = F.create_map(*[x for s, u in SPELLINGS for x in (F.lit(s), F.lit(u))])
    factor = F.create_map(*[x for u, f in SQM.items() for x in (F.lit(u), F.lit(f))])

    def parts(t: Column) -> Column:
        near = F.transform(F.regexp_extract_all(t, F.lit(_PART), F.lit(0)), lambda h: F.struct(F.regexp_extract(h, r"^\d+(?:\.\d+)?", 0).cast("double").alias("value"), names[F.regexp_replace(h, r"^\d+(?:\.\d+)?\s*", "")].alias("unit")))
        far = F.when(t.rlike(_FAR), F.array(F.struct(F.regexp_extract(t, _FAR, 1).cast("double").alias("value"), names[F.regexp_extract(t, _FAR, 2)].alias("unit"))))
        return let(near, lambda n: F.when(F.size(n) > 0, n).otherwise(far))

    def whole(kept: Column) -> Column:
        sqm = F.round(F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["value"] * factor[p["unit"]]), 3)
        unit = F.when(F.size(kept) == 1, F.get(kept, 0)["unit"]).otherwise("composite")
        return F.when(kept.isNotNull(), F.struct(sqm.alias("sqm"), unit.alias("unit"), F.exists(kept, lambda p: p["unit"].isin(*REGIONAL)).alias("regional_unit"), F.lit(False).alias("unit_missing")))

    def read(t: Column) -> Column:
        bare = F.struct(F.lit(None).cast("double").alias("sqm"), F.lit(None).cast("string").alias("unit"), F.lit(False).alias("regional_unit"), F.lit(True).alias("unit_missing"))
        return F.coalesce(let(parts(t), whole), F.when(t.rlike(r"\d"), bare))

    return let(F.replace(F.lower(normalise(raw)), F.lit(","), F.lit("")), read)


def land_class(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The code whose longest word stands in the value, null if none does; ties go to the code listed first."""
    order = sorted(((w, code, i) for i, (code, ws) in enumerate(table.items()) for w in ws), key=lambda x: (-len(x[0]), x[2]))
    words = F.array(*[F.struct(F.lit(w.lower()).alias("word"), F.lit(code).alias("code")) for w, code, _ in order])
    return let(F.lower(normalise(value)), lambda low: F.get(F.filter(words, lambda x: F.contains(low, x["word"])), 0)["code"])
