"""Readers: files and page texts to lines, shapes and transforms. Bytes are parsed in Arrow batches; what cannot be read is a null or a reason, never a failure."""

from __future__ import annotations

import codecs
import csv
import io
import re
import struct
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions.lets import let

LINE_BLOCKS = frozenset("p div br tr li h1 h2 h3 h4 table".split())
EXTENSIONS = ("docx", "odt", "xlsx", "ods", "pptx", "csv", "tsv", "html", "htm", "rtf", "txt")


def clean(text: str) -> str:
    return re.sub("[ \t ]+", " ", (text or "").replace("\r", " ")).strip()


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in LINE_BLOCKS:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" : ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in LINE_BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_lines(page: str) -> list[str]:
    """The lines of a page: tags gone, blocks on lines of their own, cells after a colon."""
    parser = _Lines()
    parser.feed(page or "")
    parser.close()
    lines = (clean(t).strip(" :") for t in "".join(parser.out).splitlines())
    return [t for t in lines if t]


def rows_to_lines(rows: list[list[str]]) -> list[str]:
    """A header and its first row as `label : value` lines; further rows joined by bars."""
    rows = [[clean(c) for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if len(rows) < 2:
        return [" ".join(c for c in r if c) for r in rows]
    head, first, *rest = rows
    out = [f"{head[k]} : {c}" if k < len(head) and head[k] else c for k, c in enumerate(first) if c]
    return out + [" | ".join(c for c in r if c) for r in rest]


# one field may be as long as a file
csv.field_size_limit(2**31 - 1)


def sniff_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample[:8192], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def delimited_lines(data: bytes) -> list[str]:
    text = data.decode("utf-8-sig", "replace")
    return rows_to_lines(list(csv.reader(io.StringIO(text, newline=""), delimiter=sniff_delimiter(text))))


def rtf_lines(data: bytes) -> list[str]:
    body = re.sub(r"\\pard?(?![a-z])", "\n", data.decode("utf-8", "replace"))
    body = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), body)
    body = re.sub(r"\\[a-zA-Z]+-?\d* ?", "", body).replace("{", "").replace("}", "")
    return [t for t in map(clean, body.splitlines()) if t]


def _member(data: bytes, name: str):
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return ElementTree.fromstring(z.read(name))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e, leaf: str | None = None) -> str:
    return "".join((x.text or "") for x in e.iter() if _local(x) == leaf) if leaf else "".join(e.itertext())


def _paragraphs(root, block: str, row: str, cell: str, text: Callable) -> list[str]:
    """Paragraphs in order; a table row of two cells or more becomes `label : rest`."""
    out: list[str] = []

    def walk(e) -> None:
        name = _local(e)
        if name == row:
            cells = [clean(text(c)) for c in e if _local(c) == cell]
            cells = [c for c in cells if c]
            if len(cells) > 1:
                out.append(f"{cells[0]} : {' '.join(cells[1:])}")
            else:
                out.extend(cells)
        elif name == block:
            if t := clean(text(e)):
                out.append(t)
        else:
            for c in e:
                walk(c)

    walk(root)
    return out


def docx_lines(data: bytes) -> list[str]:
    root = _member(data, "word/document.xml")
    return [] if root is None else _paragraphs(root, "p", "tr", "tc", lambda e: _text(e, "t"))


def odt_lines(data: bytes) -> list[str]:
    root = _member(data, "content.xml")
    return [] if root is None else _paragraphs(root, "p", "table-row", "table-cell", _text)


def pptx_lines(data: bytes) -> list[str]:
    try:
        names = sorted((n for n in zipfile.ZipFile(io.BytesIO(data)).namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    except zipfile.BadZipFile:
        return []
    return [t for n in names for t in _paragraphs(_member(data, n), "p", "tr", "tc", lambda e: _text(e, "t"))]


def xlsx_lines(data: bytes) -> list[str]:
    sheet, strings = _member(data, "xl/worksheets/sheet1.xml"), _member(data, "xl/sharedStrings.xml")
    shared = [_text(s, "t") for s in strings if _local(s) == "si"] if strings is not None else []
    rows = []
    for r in [] if sheet is None else (e for e in sheet.iter() if _local(e) == "row"):
        row: list[str] = []
        for c in (e for e in r if _local(e) == "c"):
            col = 0
            for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                col = col * 26 + ord(ch) - 64
            row += [""] * (col - 1 - len(row))
            value = next((x.text or "" for x in c if _local(x) == "v"), "")
            kind = c.get("t")
            row.append(shared[int(value)] if kind == "s" and value.isdigit() and int(value) < len(shared) else _text(c, "t") if kind == "inlineStr" else value)
        rows.append(row)
    return rows_to_lines(rows)


def ods_lines(data: bytes) -> list[str]:
    root = _member(data, "content.xml")
    table = next((e for e in root.iter() if _local(e) == "table"), None) if root is not None else None
    return [] if table is None else rows_to_lines([[_text(c) for c in r if _local(c) == "table-cell"] for r in table.iter() if _local(r) == "table-row"])


READERS: dict[str, Callable[[bytes], list[str]]] = {
    "docx": docx_lines, "odt": odt_lines, "xlsx": xlsx_lines, "ods": ods_lines, "pptx": pptx_lines, "csv": delimited_lines, "tsv": delimited_lines, "rtf": rtf_lines,
    "html": lambda b: html_lines(b.decode("utf-8", "replace")), "htm": lambda b: html_lines(b.decode("utf-8", "replace")), "txt": lambda b: [t for t in map(clean, b.decode("utf-8", "replace").splitlines()) if t],
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, engine, lines and reason of every file under a path, by extension; engine is unsupported for others.

    A file that its reader cannot make out has null lines and the reason; it never fails the job.
    """
    files = spark.read.format("binaryFile").load(path)

    @F.pandas_udf(T.StructType([T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())]))
    def lines(name: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([attempted(READERS.get(n.rsplit(".", 1)[-1].lower()), c) for n, c in zip(name, content, strict=True)], columns=["lines", "reason"])

    ext = F.lower(F.substring_index("path", ".", -1))
    return files.select("path", F.when(ext.isin(*READERS), ext).otherwise("unsupported").alias("engine"), lines("path", "content").alias("r")).select("path", "engine", "r.lines", "r.reason")


def attempted(reader, content: bytes) -> tuple[list[str] | None, str | None]:
    """What a reader makes of a file, or why it makes nothing of it."""
    if reader is None:
        return [], None
    try:
        return reader(content), None
    except (ValueError, LookupError, TypeError, AttributeError, RecursionError, struct.error, csv.Error, zipfile.BadZipFile, ElementTree.ParseError) as why:
        return None, f"{type(why).__name__}: {why}"


def page_lines(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` with the lines of their html."""

    @F.pandas_udf("array<string>")
    def lines(page: pd.Series) -> pd.Series:
        return page.map(html_lines)

    return pages.withColumn("lines", lines(F.col(html_col)))


def text_lines(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per line that is not blank, numbered from 0."""
    return docs.select(*keep, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "text")).where(F.trim("text") != "")


GEOJSON = "struct<type:string,features:array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>"


def geojson_features(docs: DataFrame, json_col: str) -> DataFrame:
    """Features of polygon collections: number, properties and the outer ring, opened."""
    f = docs.select(F.posexplode(F.from_json(json_col, GEOJSON)["features"]).alias("n", "f"))
    ring = F.transform(F.get(F.col("f.geometry.coordinates"), 0), lambda p: g.point(F.get(p, 0), F.get(p, 1)))
    return f.select("n", F.col("f.properties").alias("properties"), g.opened(ring).alias("ring"))


CITYJSON = "struct<type:string,version:string,transform:struct<scale:array<double>,translate:array<double>>,vertices:array<array<double>>,CityObjects:map<string,struct<type:string,attributes:map<string,string>,geometry:array<struct<type:string,lod:string,boundaries:array<array<array<int>>>>>>>>"


def cityjson_parcels(docs: DataFrame, json_col: str) -> DataFrame:
    """Objects of a CityJSON text: id, attributes, the outer ring of the largest surface, and the number of surfaces.

    Vertices are scaled and moved where the file says so. Rings are not closed in CityJSON; a repeated
    first vertex is dropped. Surfaces without area are left out.
    """
    c = docs.select(F.from_json(json_col, CITYJSON).alias("c")).where("c.type = 'CityJSON'")
    scale, move = F.col("c.transform.scale"), F.col("c.transform.translate")

    def at(v: Column, k: int) -> Column:
        return F.get(v, k) * F.coalesce(F.get(scale, k), F.lit(1.0)) + F.coalesce(F.get(move, k), F.lit(0.0))

    def read(vs: Column) -> Column:
        """The objects with their rings, so that no row has more of the vertices than its own."""

        def sized(o: Column) -> Column:
            surfaces = F.flatten(F.transform(o["geometry"], lambda s: s["boundaries"]))
            rings = F.transform(surfaces, lambda s: let(F.transform(F.get(s, 0), lambda i: F.get(vs, i)), g.opened))
            return F.filter(F.transform(rings, lambda r: F.struct((-g.area(r)).alias("minus"), r.alias("ring"))), lambda x: x["minus"] < 0)

        def row(e: Column) -> Column:
            largest = lambda s: F.struct(e["key"].alias("object_id"), e["value"]["attributes"].alias("attributes"), F.get(F.array_sort(s), 0)["ring"].alias("ring"), F.size(s).alias("surfaces"))
            return let(sized(e["value"]), largest)

        return F.transform(F.map_entries("c.CityObjects"), row)

    vertices = F.transform("c.vertices", lambda v: F.struct(at(v, 0).alias("x"), at(v, 1).alias("y")))
    return c.select(F.explode(let(vertices, read)).alias("o")).select("o.*")


def world_file(text: Column) -> Column:
    """struct<a, b, c, d, e, f> of a six-line world file (written a, d, b, e, c, f); null if a line is no number."""
    n = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    fine = (F.size(n) == 6) & ~F.exists(n, lambda x: x.isNull())
    return F.when(fine, F.struct(*[F.get(n, k).alias(name) for name, k in zip("abcdef", (0, 2, 4, 1, 3, 5), strict=True)]))


def shp_rings(data: bytes) -> list[list[tuple[float, float]]]:
    """The outer rings (clockwise in the file, turned here) of each polygon record: the largest one. A cut-off record ends the file."""
    out, at = [], 100
    while at + 12 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        body, at = at + 8, at + 8 + size
        if size < 4 or at > len(data):
            break
        if kind not in (5, 15, 25):
            out.append([])
            continue
        n_parts, n_points = struct.unpack_from("<2i", data, body + 36) if size >= 44 else (0, 0)
        if n_parts < 1 or n_points < 1 or 44 + 4 * n_parts + 16 * n_points > size:
            out.append([])
            continue
        parts = [*struct.unpack_from(f"<{n_parts}i", data, body + 44), n_points]
        xy = struct.unpack_from(f"<{2 * n_points}d", data, body + 44 + 4 * n_parts)
        points = list(zip(xy[::2], xy[1::2], strict=True))
        rings = [points[a:z] for a, z in zip(parts[:-1], parts[1:], strict=True)]
        area = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1], strict=True)) / 2
        outer = [r for r in rings if area(r) < 0] or rings
        best = max(outer, key=lambda r: abs(area(r)), default=[])
        best = best[:-1] if len(best) > 1 and best[0] == best[-1] else best
        out.append(best[::-1] if area(best) < 0 else best)
    return out


def dbf_rows(data: bytes, encoding: str = "latin-1") -> list[dict[str, str]]:
    """The records of a dBASE table as text by field; deleted ones are kept under `_deleted`, cut-off ones left out."""
    if len(data) < 32:
        return []
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at + 17 <= len(data) and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), data[at + 16]))
        at += 32
    out = []
    for k in range(n):
        row, place = data[head + k * size : head + (k + 1) * size], 1
        if not size or len(row) < size:
            break
        rec = {"_deleted": "1" if row[:1] == b"*" else ""}
        for name, width in fields:
            rec[name] = row[place : place + width].decode(encoding, "replace").strip()
            place += width
        out.append(rec)
    return out


KHASRA_NAMES = ("khasra", "khasrano", "khasranumber", "plotno", "plotnumber", "surveyno", "parcelno", "gatano")


def pick_khasra(names: Column) -> Column:
    """The attribute that holds the plot number: the first of the usual names, whatever case and signs."""
    flat = F.transform(names, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", ""))
    return F.coalesce(*[F.when(F.array_contains(flat, k), F.get(names, (F.array_position(flat, F.lit(k)) - 1).cast("int"))) for k in KHASRA_NAMES])


def crs_of(wkt: Column) -> Column:
    """struct<name, projected> of a .prj text; null without one."""
    name = F.nullif(F.regexp_extract(wkt, r'^\s*[A-Za-z]+\s*\[\s*"([^"]*)"', 1), F.lit(""))
    return F.when(wkt.isNotNull(), F.struct(name.alias("name"), wkt.rlike(r"(?i)^\s*PROJ").alias("projected")))


def encoding_of(cpg: str | None, language: int | None, default: str = "latin-1") -> str:
    """The code page of a .dbf: what the .cpg names, else the table's own mark for UTF-8, else `default`."""
    name = (cpg or "").strip().lower().replace("ansi ", "cp")
    name = f"cp{name}" if name.isdigit() else name
    try:
        return codecs.lookup(name).name if name else ("utf-8" if language == 0x08 else default)
    except LookupError:
        return default


def read_shapefile(spark: SparkSession, path: str, encoding: str = "latin-1") -> DataFrame:
    """stem, parcel_no, attributes, ring, crs and warnings of every .shp under a path, with the .dbf, .prj and .cpg beside it."""
    both = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"), F.lower(F.substring_index("path", ".", -1)).alias("ext"), "content")
    wide = both.groupBy("stem").agg(*[F.max(F.when(F.col("ext") == e, F.col("content"))).alias(e) for e in ("shp", "dbf", "prj", "cpg")]).where("shp IS NOT NULL")

    def parse(it):
        for pdf in it:
            for r in pdf.itertuples():
                cpg = None if r.cpg is None else bytes(r.cpg).decode("ascii", "replace")
                page = encoding_of(cpg, r.dbf[29] if r.dbf is not None and len(r.dbf) > 29 else None, encoding)
                rings, why = attempted(shp_rings, r.shp)
                rows, why_not = attempted(lambda b: dbf_rows(b, page), r.dbf) if r.dbf is not None else ([], "no .dbf")
                rings, rows = rings or [], rows or []
                said = [x for x in (why, why_not, "no .prj" if r.prj is None else None, f"{len(rings)} shapes, {len(rows)} records" if rows and len(rows) != len(rings) else None) if x]
                yield pd.DataFrame({"stem": [r.stem] * len(rings), "parcel_no": range(1, len(rings) + 1), "attributes": [rows[k] if k < len(rows) else {} for k in range(len(rings))], "ring": [[{"x": x, "y": y} for x, y in ring] for ring in rings], "prj": [None if r.prj is None else bytes(r.prj).decode("utf-8", "replace")] * len(rings), "warnings": [said] * len(rings)})

    read = wide.mapInPandas(parse, f"stem string, parcel_no int, attributes map<string,string>, ring {g.RING}, prj string, warnings array<string>")
    return read.withColumn("crs", crs_of(F.col("prj"))).drop("prj")
