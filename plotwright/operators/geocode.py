"""Approximate coordinates from place names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_vowel_runs, normalise, word_ngrams

# How specific a level is, its accuracy in metres, and the levels each field may name.
LEVELS = {"state": (0, 300_000), "district": (1, 40_000), "locality": (2, 5_000)}
FIELD_LEVELS = {"village": ("locality", "district"), "tehsil": ("locality", "district"), "district": ("district",), "state": ("state",)}
NOISE = ("village", "vill", "gram", "mauza", "tehsil", "taluk", "taluka", "block", "district", "distt", "dist", "state", "road", "street", "colony", "sector", "near", "plot", "khasra", "khata", "area", "land")


def place_key(c: Column) -> Column:
    return fold_vowel_runs(normalise(c))


def tokens(value: Column) -> Column:
    """Names that a value may hold: each segment whole, its runs of three and two words, then its words; noise words are left out."""

    def of(segment: Column) -> Column:
        words = F.filter(F.regexp_extract_all(segment, F.lit("[A-Za-zऀ-ॿ]+"), F.lit(0)), lambda w: ~place_key(w).isin(*NOISE))
        whole = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(whole, word_ngrams(words, 3), word_ngrams(words, 2), words)

    return F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(value, F.lit("")), r"[,;/|\n]+"), of)))


def candidates(records: DataFrame, places: DataFrame, fields=FIELD_LEVELS) -> DataFrame:
    """Every place that a field of a record names: the first level that knows the token wins for that token."""
    levels = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(lv).alias("level"), F.lit(k).alias("at")) for f, lvs in fields.items() for k, lv in enumerate(lvs)]
    asked = records.select("id", F.explode(F.array(*levels)).alias("q")).select("id", "q.*")
    t = asked.select("id", "field", "level", "at", F.explode(tokens(F.col("value"))).alias("token")).withColumn("key", place_key(F.col("token")))
    p = places.withColumn("key", place_key(F.col("name")))
    hit = t.join(p, ["level", "key"])
    first = hit.groupBy("id", "field", "token").agg(F.min("at").alias("at"))
    return hit.join(first, ["id", "field", "token", "at"])


def resolve(records: DataFrame, places: DataFrame, fields=FIELD_LEVELS) -> DataFrame:
    """The best place of each record: the most specific that does not contradict a stated state.

    corroborated: a coarser level agrees; conflicts: named places of other states. Ties go to the
    shorter token, then by name.
    """
    found = candidates(records, places, fields)
    states = found.where("level = 'state'").groupBy("id").agg(F.collect_set("name").alias("states"))
    districts = found.where("level = 'district'").groupBy("id").agg(F.collect_set("name").alias("districts"))
    f = found.join(states, "id", "left").join(districts, "id", "left")
    agrees = F.col("states").isNull() | F.col("state").isNull() | F.array_contains("states", F.col("state"))
    f = f.withColumn("agrees", agrees)
    rank = F.create_map(*[x for k, (n, _) in LEVELS.items() for x in (F.lit(k), F.lit(n))])[F.col("level")]
    order = F.struct((~F.col("agrees")).cast("int"), -rank, F.length("token"), F.col("name"))
    best = f.groupBy("id").agg(
        F.min_by(F.struct("name", "level", "lat", "lon", "state", "district", "states", "districts", "agrees"), order).alias("b"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("agrees"), F.concat_ws(":", "name", "state")))), ",").alias("conflicts"),
    )
    accuracy = F.create_map(*[x for k, (_, m) in LEVELS.items() for x in (F.lit(k), F.lit(m))])[F.col("b.level")]
    sure = (F.col("b.level") != "state") & F.coalesce(F.array_contains("b.states", F.col("b.state")), F.lit(False))
    sure = sure | ((F.col("b.level") == "locality") & F.coalesce(F.array_contains("b.districts", F.col("b.district")), F.lit(False)))
    return best.select("id", "b.name", "b.level", "b.lat", "b.lon", accuracy.alias("accuracy_m"), sure.alias("corroborated"), "conflicts")
