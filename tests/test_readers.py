"""File readers on small files made here."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from plotwright.sources import readers


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_lines_of_each_format():
    assert readers.html_lines("<p>A</p><script>x</script><table><tr><td>Khasra</td><td>213/1</td></tr></table>") == ["A", "Khasra : 213/1"]
    assert readers.delimited_lines(b"Khasra;Owner\n213/1;Ram\n214;Sita\n") == ["Khasra : 213/1", "Owner : Ram", "214 | Sita"]
    assert readers.rtf_lines(rb"{\rtf1 Khasra\'3a 213\par Owner}") == ["Khasra: 213", "Owner"]
    docx = zipped(word__document_xml='<d xmlns:w="w"><w:p><w:t>Title</w:t></w:p><w:tr><w:tc><w:p><w:t>Khasra</w:t></w:p></w:tc><w:tc><w:p><w:t>213/1</w:t></w:p></w:tc></w:tr></d>')
    assert readers.docx_lines(docx) == ["Title", "Khasra : 213/1"]
    xlsx = zipped(xl__worksheets__sheet1_xml='<s><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Area</t></is></c></row><row><c r="A2"><v>12</v></c><c r="B2"><v>3.5</v></c></row></s>', xl__sharedStrings_xml="<s><si><t>Khasra</t></si></s>")
    assert readers.xlsx_lines(xlsx) == ["Khasra : 12", "Area : 3.5"]
    assert readers.docx_lines(b"no zip") == [] and readers.xlsx_lines(b"") == []


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Khasra,Owner\n213/1,Ram\n")
    (tmp_path / "b.html").write_text("<p>Village : Rampur</p>")
    (tmp_path / "c.bin").write_bytes(b"\0")
    got = {r.path.rsplit("/", 1)[-1]: (r.engine, list(r.lines)) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("csv", ["Khasra : 213/1", "Owner : Ram"]), "b.html": ("html", ["Village : Rampur"]), "c.bin": ("unsupported", [])}


def shp(rings):
    records = b""
    for k, ring in enumerate(rings, 1):
        body = struct.pack("<i4d2i1i", 5, 0, 0, 1, 1, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        records += struct.pack(">2i", k, len(body) // 2) + body
    return b"\0" * 100 + records


def test_shapefile(spark, tmp_path):
    clockwise = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    (tmp_path / "v.shp").write_bytes(shp([clockwise]))
    field = b"KHASRA_NO".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6]) + b"\0" * 15
    (tmp_path / "v.dbf").write_bytes(struct.pack("<BBBBIHH", 3, 1, 1, 1, 1, 32 + 32 + 1, 7) + b"\0" * 20 + field + b"\r" + b" " + b"213/1 ")
    (row,) = readers.read_shapefile(spark, str(tmp_path)).collect()
    assert row.attributes["KHASRA_NO"] == "213/1" and [(p.x, p.y) for p in row.ring] == [(2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    names = spark.createDataFrame([(["NAME", "Khasra_No"],)], "n array<string>")
    assert names.select(readers.pick_khasra(F.col("n"))).first()[0] == "Khasra_No"


def test_readers_never_fail_the_job(spark, tmp_path):
    """Truncated and overlong files give what is whole, or null and a reason."""
    head = b"\0" * 100
    square = struct.pack("<4d2i1i10d", 0, 0, 1, 1, 1, 5, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0)
    body = struct.pack("<i", 5) + square
    record = struct.pack(">2i", 1, len(body) // 2) + body
    table = struct.pack("<4xIHH", 2, 65, 6) + b"\0" * 20 + b"KHASRA".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15 + b"\r" + b" 12/1 " + b" 1"
    (tmp_path / "a.shp").write_bytes(head + record + record[:40])
    (tmp_path / "a.dbf").write_bytes(table)
    (tmp_path / "a.prj").write_text('PROJCS["WGS 84 / UTM zone 44N",GEOGCS["x"]]')
    (r,) = readers.read_shapefile(spark, str(tmp_path / "a.*")).collect()
    assert len(r.ring) == 4 and r.attributes["KHASRA"] == "12/1" and r.crs.name == "WGS 84 / UTM zone 44N" and r.crs.projected and r.warnings == []
    for cut in range(0, len(record) + 100, 7):
        assert len(readers.shp_rings((head + record)[:cut])) <= 1
    for cut in range(0, len(table), 3):
        readers.dbf_rows(table[:cut])
    assert readers.encoding_of("65001", None) == readers.encoding_of(None, 8) == "utf-8" or readers.encoding_of("UTF-8", None) == "utf-8"
    (tmp_path / "long.csv").write_text("a," + "x" * 300_000 + "\n")
    (tmp_path / "bad.docx").write_bytes(b"PK not a zip")
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.read_files(spark, str(tmp_path / "*.[cd][so][vc]*")).collect()}
    assert "x" * 300_000 in got["long.csv"].lines[0] and got["long.csv"].reason is None
    assert readers.attempted(lambda b: b[9], b"") == (None, "IndexError: index out of range")
