"""Exports: wide tables, nested records, GeoJSON and CityJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.records import wide

NEWEST = 5000


def newest(documents: DataFrame, limit: int = NEWEST) -> DataFrame:
    return documents.orderBy(F.desc("id")).limit(limit)


def wide_rows(documents: DataFrame, fields: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Records beside their fields, one column a key."""
    w = wide(fields, keys)
    return documents.select("id", "filename", "status", "trust_score").join(w, F.col("id") == F.col("document_id"), "left").drop("document_id")


def nested_rows(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Records as JSON with their fields in key order."""
    f = fields.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("field_key", "value", "status"))).alias("fields"))
    j = documents.select("id", "filename", "status").join(f, F.col("id") == F.col("document_id"), "left")
    return j.select("id", F.to_json(F.struct("id", "filename", "status", "fields")).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def geojson(parcels: DataFrame) -> DataFrame:
    """One GeoJSON feature per parcel (parcel_id, khasra_number, ring)."""
    ring = F.transform(g.closed(F.col("ring")), lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("parcel_id", "khasra_number").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return parcels.select("parcel_id", F.to_json(feature).alias("feature"))


def cityjson(parcels: DataFrame, key: str) -> DataFrame:
    """One CityJSON 2.0 text per sheet. Heights are absent and marked as placeholders.

    Vertices are listed parcel by parcel, so an object's indices start where the parcels before it end;
    the offsets are a running sum within the sheet.
    """
    from pyspark.sql import Window

    r = parcels.select(key, "parcel_id", "khasra_number", g.opened(F.col("ring")).alias("ring"))
    before = F.coalesce(F.sum(F.size("ring")).over(Window.partitionBy(key).orderBy("parcel_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    r = r.withColumn("first", before)
    face = F.transform("ring", lambda p, i: F.col("first") + i)
    obj = F.struct(F.lit("GenericCityObject").alias("type"), F.struct("parcel_id", "khasra_number", F.lit(True).alias("z_is_placeholder")).alias("attributes"), F.array(F.struct(F.lit("MultiSurface").alias("type"), F.lit("0").alias("lod"), F.array(F.array(face)).alias("boundaries"))).alias("geometry"))
    entry = F.struct("parcel_id", F.struct(F.concat(F.lit("parcel-"), F.col("parcel_id").cast("string")).alias("k"), obj.alias("v")).alias("e"), F.transform("ring", lambda p: F.array(p["x"], p["y"], F.lit(0.0))).alias("vs"))
    box = g.bbox(F.col("ring"))
    s = r.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("all"), F.min(box["x0"]).alias("x0"), F.min(box["y0"]).alias("y0"), F.max(box["x1"]).alias("x1"), F.max(box["y1"]).alias("y1"))
    zero = F.lit(0.0)
    doc = F.struct(
        F.lit("CityJSON").alias("type"), F.lit("2.0").alias("version"),
        F.struct(F.array("x0", "y0", zero, "x1", "y1", zero).alias("geographicalExtent"), F.lit("https://www.opengis.net/def/crs/EPSG/0/4979").alias("referenceSystem")).alias("metadata"),
        F.map_from_entries(F.transform("all", lambda x: x["e"])).alias("CityObjects"), F.flatten(F.transform("all", lambda x: x["vs"])).alias("vertices"),
    )
    return s.select(key, F.to_json(doc).alias("json"))
