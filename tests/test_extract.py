"""Extractors of files and listing of trees."""

import io
import os
import struct
import zipfile

from pyspark.sql import functions as F

from stowage.sources import extract, listing


def packed(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


CORE = "<p xmlns:dc='d' xmlns:t='t'><dc:title> A &amp; B </dc:title><dc:creator>X</dc:creator><t:created>2024-02-30T10:00:00Z</t:created></p>"
DOCX = packed(word__document="<d xmlns:w='w'><w:p><w:t>a &lt;b</w:t><w:tab/><w:t>c</w:t></w:p><w:p>no<w:t>d</w:t></w:p></d>", docProps__core=CORE, docProps__app="<p><Pages>3</Pages></p>")


def jpeg(order, make, model, gps, taken=None):
    """A JPEG with an Exif block: three directories, one after another."""
    blobs, base = b"", 8 + 3 * (2 + 6 * 12 + 4)

    def entry(tag, kind, raw, count):
        nonlocal blobs
        if len(raw) > 4:
            at, blobs = base + len(blobs), blobs + raw
            raw = struct.pack(order + "I", at)
        return struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")

    def directory(*entries):
        return (struct.pack(order + "H", len(entries)) + b"".join(entries) + bytes(4)).ljust(78, b"\0")

    def text(tag, s):
        return entry(tag, 2, s.encode() + b"\0", len(s) + 1)

    def angle(tag, value):
        seconds = round(abs(value) * 3600 * 1000)
        return entry(tag, 5, struct.pack(order + "6I", 0, 1, 0, 1, seconds, 1000), 3)

    place = [text(1, "NS"[gps[0] < 0]), angle(2, gps[0]), text(3, "EW"[gps[1] < 0]), angle(4, gps[1])] if gps else []
    whole = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    whole += directory(text(0x10F, make), text(0x110, model), entry(0x8769, 4, struct.pack(order + "I", 86), 1), entry(0x8825, 4, struct.pack(order + "I", 164), 1))
    whole += directory(*([text(0x9003, taken)] if taken else [])) + directory(*place)
    block = b"Exif\0\0" + whole + blobs
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xd9"


def movie(seconds, version=0):
    mvhd = bytes([version, 0, 0, 0]) + seconds.to_bytes(8 if version else 4, "big") + bytes(20)
    box = lambda kind, x: struct.pack(">I", len(x) + 8) + kind + x
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(100)) + box(b"moov", box(b"free", b"") + box(b"mvhd", mvhd))


def test_office():
    assert extract.one(DOCX, "docx", 1 << 20, 100) == ("ok", "a <b c\nd\n", {"doc.title": "A & B", "doc.author": "X", "doc.pages": "3"})
    assert extract.one(DOCX, "docx", 1 << 20, 3)[1] == "a <"
    slides = packed(**{f"ppt__slides__slide{i}": f"<a><t>{i}</t><p/></a>" for i in (10, 2, 1)})
    assert extract.one(slides, "pptx", 1 << 20, 100)[1] == "1\n2\n10\n"
    sheet = packed(xl__sharedStrings="<s><si><t>x</t></si></s>", xl__worksheets__sheet1="<s><is><t>y</t></is></s>")
    assert extract.one(sheet, "xlsx", 1 << 20, 100)[1] == "x\ny"


def test_unreadable_files():
    assert extract.one(b"\xd0\xcf\x11\xe0rest", "docx", 99, 9)[0] == "encrypted"
    assert extract.one(b"PK nonsense", "docx", 99, 9)[0] == "corrupt"
    assert extract.one(packed(word__document="<d><t>"), "docx", 1 << 20, 9)[0] == "corrupt"
    bomb = packed(word__document="<!DOCTYPE d [<!ENTITY e 'xx'>]><d><t>&e;</t></d>")
    assert extract.one(bomb, "docx", 1 << 20, 9)[0] == "corrupt"
    assert extract.one(packed(word__document="<d>" + " " * (3 << 20) + "</d>"), "docx", 1 << 20, 9)[0] == "too_large"
    assert extract.one(DOCX, "docx", 10, 9) == ("too_large", None, {})
    assert extract.one(b"x", "txt", 10, 9)[0] == "unsupported" and extract.one(b"x", None, 10, 9)[0] == "unsupported"
    assert extract.one(None, "docx", 10, 9)[0] == "vanished"
    for cut in range(0, len(DOCX), 7):
        extract.one(DOCX[:cut], "docx", 1 << 20, 9)


def test_images():
    for order in "<>":
        got = extract.image(jpeg(order, "Canon", "Canon EOS 80D", (48.5, -11.25), "2024:05:06 07:08:09"))
        assert got == {"exif.camera": "Canon EOS 80D", "exif.taken": "2024-05-06T07:08:09", "exif.has_gps": "true", "exif.lat": "48.50000", "exif.lon": "-11.25000"}
    assert extract.image(jpeg("<", "Apple", "iPhone 15", (0.0, 0.0))) == {"exif.camera": "Apple iPhone 15", "exif.has_gps": "false"}
    assert extract.image(jpeg(">", "", "", None, "nonsense")) == {"exif.has_gps": "false"}
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + bytes(9)
    assert extract.image(png) == {"img.width": "640", "img.height": "480"}
    whole = jpeg("<", "A", "B", (1.0, 2.0))
    for cut in range(len(whole)):
        extract.image(whole[:cut])


def test_videos():
    stamp = extract.MAC_EPOCH + 86_400
    assert extract.video(movie(stamp)) == extract.video(movie(stamp, 1)) == {"video.date": "1970-01-02T00:00:00"}
    assert extract.video(movie(0)) == extract.video(b"") == extract.video(movie(2**64 - 1, 1)) == {}
    whole = movie(stamp)
    assert all(extract.video(whole[:cut]) == {} for cut in range(len(whole)))


def test_extract_column(spark, tmp_path):
    rows = [("a.docx", "DOCX", bytearray(DOCX)), ("b.mp4", "mp4", bytearray(movie(extract.MAC_EPOCH + 1))), ("c", None, None), ("d.png", "png", None)]
    files = spark.createDataFrame(rows, "path string, ext string, content binary")
    got = {r.path: r.extracted for r in extract.extract(files).collect()}
    assert got["a.docx"].text == "a <b c\nd\n" and got["a.docx"].meta["doc.title"] == "A & B"
    assert got["b.mp4"].meta == {"video.date": "1970-01-01T00:00:01"} and (got["c"].status, got["d.png"].status) == ("unsupported", "vanished")
    assert extract.extract(files.limit(0)).collect() == []


def test_walk(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "leer").mkdir()
    (tmp_path / "a" / "X.TXT").write_text("12345")
    (tmp_path / "a" / "b" / ".hidden").write_text("1")
    os.symlink(tmp_path / "a", tmp_path / "a" / "b" / "loop")
    got = {r.path: r for r in listing.walk(spark, f"{tmp_path}/").collect()}
    assert set(got) == {f"{tmp_path}/{p}" for p in ("a", "a/b", "leer", "a/X.TXT", "a/b/.hidden", "a/b/loop")}
    file = got[f"{tmp_path}/a/X.TXT"]
    assert (file.kind, file.ext, file.size, file.is_link) == ("file", "txt", 5, False) and file.dir_key == f"{tmp_path}/a/".lower()
    assert file.mtime == os.stat(file.path).st_mtime_ns // 100
    assert got[f"{tmp_path}/a/b/.hidden"].ext is None and got[f"{tmp_path}/a/b/loop"].is_link
    assert [r.kind for r in listing.walk(spark, f"{tmp_path}/none").collect()] == ["error"]


def test_dir_modes(spark):
    names = ["/r", "/r/.git", "/r/x/bin", "/r/obj", "/r/tool", "/r/area/y", "/r/$Recycle.Bin", "/r/Own", "/r/plain"]
    rows = spark.createDataFrame([(p, p.rpartition("/")[2], p == "/r/x/bin") for p in names], "path string, name string, project boolean")

    def modes(**options):
        mode = listing.dir_mode(F.col("path"), F.col("name"), "/r/", exclude=["own"], tool_dir="tool", areas={"summary": ["/r/area/"], "exclude": ["/"]}, beside_project=F.col("project"), **options)
        return [r.m for r in rows.select(mode.alias("m")).collect()]

    assert modes() == ["full", "summary", "summary", "full", "exclude", "summary", "exclude", "exclude", "full"]
    assert modes(defaults=False) == ["full", "full", "full", "full", "exclude", "full", "full", "exclude", "full"]
    page = spark.createDataFrame([("/r/Pagefile.sys", "Pagefile.sys"), ("/r/x.iso", "x.iso"), ("/r/y", "y")], "path string, name string")
    assert [r[0] for r in page.select(listing.excluded_file(F.col("path"), F.col("name"), ["*.ISO"])).collect()] == [True, True, False]
