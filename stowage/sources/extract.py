"""Text and metadata of office files, images and videos (SRC20-SRC24).

``extract`` takes rows with a file's bytes (``binaryFile`` or any other source)
and adds a struct. Files are looked at one by one on the executors, a batch
holds only as many as ``spark.sql.execution.arrow.maxRecordsPerBatch`` allows.

Defined results: null bytes give the status ``vanished``; a broken file is
``corrupt``, an encrypted office file ``encrypted``, an archive beyond the
limits below, or a file of more than ``max_bytes``, ``too_large``; other
extensions are ``unsupported``. Images and videos without metadata are ``ok``.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, date, datetime
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

IMAGES = ["jpg", "jpeg", "png", "heic", "heif", "tif", "tiff", "webp"]
VIDEOS = ["mp4", "mov", "m4v", "3gp"]
OFFICE = ["docx", "xlsx", "pptx"]
#: Limits of an archive: entries, bytes of one and of all, and how far an entry of over 1 MB may unfold; sheets or slides read.
MAX_ENTRIES, MAX_ENTRY, MAX_ALL, MAX_RATIO, MAX_PARTS = 2_000, 50 << 20, 200 << 20, 100, 60
#: Seconds from 1904 to 1970; most bytes of a video's index.
MAC_EPOCH, MAX_INDEX = 2_082_844_800, 64 << 20
_OLE = b"\xd0\xcf\x11\xe0"


class Unreadable(Exception):
    """A file that can't be read; its text is the status."""


class _Enough(Exception):
    pass


# ---------------------------------------------------------------- office files
def _parse(xml: bytes, start, end, said) -> None:
    parser = expat.ParserCreate()
    local = lambda name: name.rpartition(":")[2]
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, _: start(local(name))
    parser.EndElementHandler = lambda name: end(local(name))
    parser.CharacterDataHandler = said

    def refuse(*_) -> None:
        raise Unreadable("corrupt")

    parser.EntityDeclHandler = refuse
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        raise Unreadable("corrupt") from None


def xml_text(xml: bytes, most: int) -> str:
    """Text of all ``t`` elements; paragraphs and shared strings end a line. At most about ``most`` characters are gathered."""
    out: list[str] = []
    size, inside = 0, False

    def put(text: str) -> None:
        nonlocal size
        out.append(text)
        size += len(text)
        if size >= most:
            raise _Enough

    def start(name: str) -> None:
        nonlocal inside
        if name == "t":
            inside = True
        elif name in ("tab", "br"):
            put(" " if name == "tab" else "\n")

    def end(name: str) -> None:
        nonlocal inside
        if name == "t":
            inside = False
        elif name in ("p", "si"):
            put("\n")

    try:
        _parse(xml, start, end, lambda text: put(text) if inside else None)
    except _Enough:
        pass
    return "".join(out)


def xml_properties(xml: bytes, names: list[str]) -> dict[str, str]:
    """The trimmed text of each named element; what follows a syntax error is missing."""
    found: dict[str, str] = {}
    now: str | None = None

    def start(name: str) -> None:
        nonlocal now
        now = name if name in names else None

    def end(name: str) -> None:
        nonlocal now
        now = None

    def said(text: str) -> None:
        if now and text.strip():
            found.setdefault(now, text.strip())

    try:
        _parse(xml, start, end, said)
    except Unreadable:
        pass
    return found


def office(data: bytes, ext: str, most: int) -> tuple[str | None, dict[str, str]]:
    """(text, metadata) of a docx, xlsx or pptx file."""
    if data.startswith(_OLE):
        raise Unreadable("encrypted")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        entries = archive.infolist()
        folds = any(e.file_size > 1 << 20 and e.file_size // max(1, e.compress_size) > MAX_RATIO for e in entries)
        if len(entries) > MAX_ENTRIES or folds or any(e.file_size > MAX_ENTRY for e in entries) or sum(e.file_size for e in entries) > MAX_ALL:
            raise Unreadable("too_large")
        names = [e.filename for e in entries]

        def read(name: str) -> bytes | None:
            if name not in names:
                return None
            with archive.open(name) as entry:
                held = entry.read(MAX_ENTRY + 1)
            if len(held) > MAX_ENTRY:
                raise Unreadable("too_large")
            return held

        def numbered(prefix: str) -> list[str]:
            fits = [n for n in names if n.startswith(prefix) and n.endswith(".xml")]
            return sorted(fits, key=lambda n: int("0" + re.sub("[^0-9]", "", n)))[:MAX_PARTS]

        wanted = {"docx": lambda: ["word/document.xml"], "pptx": lambda: numbered("ppt/slides/slide"), "xlsx": lambda: ["xl/sharedStrings.xml", *numbered("xl/worksheets/sheet")]}
        text = ""
        for name in wanted[ext]():
            if len(text) < most and (xml := read(name)) is not None:
                text += xml_text(xml, most - len(text))
        meta = {}
        core = xml_properties(read("docProps/core.xml") or b"", ["title", "creator", "created"])
        meta |= {key: core[name] for key, name in (("doc.title", "title"), ("doc.author", "creator")) if name in core}
        if day := re.match(r"(\d{4})-(\d{1,2})-(\d{1,2})", core.get("created", "")):
            try:
                meta["doc.created"] = date(*map(int, day.groups())).isoformat()
            except ValueError:
                pass
        pages = xml_properties(read("docProps/app.xml") or b"", ["Slides" if ext == "pptx" else "Pages"])
        for count in pages.values():
            if re.fullmatch(r"[0-9]{1,9}", count) and int(count):
                meta["doc.pages"] = str(int(count))
        return (text[:most] if text.strip() else None), meta
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError, ValueError, struct.error):
        raise Unreadable("corrupt") from None


# ---------------------------------------------------------------------- images
#: Tags of images and the sizes of their types.
_MAKE, _MODEL, _EXIF, _GPS, _TAKEN = 0x10F, 0x110, 0x8769, 0x8825, (0x9003, 0x9004)
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _directory(data: bytes, order: str, at: int) -> dict[int, tuple[int, bytes, int]]:
    """Tag -> (type, bytes, number) of an image directory."""
    found = {}
    if at + 2 <= len(data):
        (n,) = struct.unpack_from(f"{order}H", data, at)
        for i in range(n):
            place = at + 2 + 12 * i
            if place + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, place)
            size = _SIZES.get(kind, 0) * count
            start = place + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, place + 8)[0]
            if size and start + size <= len(data):
                found.setdefault(tag, (kind, data[start : start + size], count))
    return found


def exif_block(data: bytes) -> bytes:
    """The TIFF structure with an image's metadata (JPEG, TIFF, PNG, WebP); empty if there is none."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + max(2, size)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"EXIF":
                return data[at + 8 : at + 8 + size].removeprefix(b"Exif\0\0")
            at += 8 + size + size % 2
    return b""


def camera(make: str, model: str) -> str | None:
    """Maker and model; a model that already starts with its maker stays alone."""
    make, model = (" ".join(x.replace("\0", " ").split()) for x in (make, model))
    return (model if model.lower().startswith(make.lower()) else f"{make} {model}".strip()) or None


def _degrees(gps: dict, tag: int, order: str, negative: str) -> float | None:
    kind, raw, count = gps.get(tag, (0, b"", 0))
    if kind != 5 or count < 3 or tag - 1 not in gps:
        return None
    parts = struct.unpack_from(f"{order}6I", raw)
    if not all(parts[1::2]):
        return None
    value = sum(parts[i] / parts[i + 1] / 60 ** (i // 2) for i in (0, 2, 4))
    return -value if gps[tag - 1][1][:1] == negative.encode() else value


def image(data: bytes) -> dict[str, str]:
    meta: dict[str, str] = {}
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        width, height = struct.unpack(">II", data[16:24])
        if width and height:
            meta |= {"img.width": str(width), "img.height": str(height)}
    block = exif_block(data)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(block[:4])
    if order is None or len(block) < 8:
        return meta
    main = _directory(block, order, struct.unpack_from(f"{order}I", block, 4)[0])

    def below(tag: int) -> dict:
        kind, raw, _ = main.get(tag, (0, b"", 0))
        return _directory(block, order, struct.unpack(f"{order}I", raw[:4])[0]) if kind == 4 else {}

    def text(found: dict, tag: int) -> str:
        kind, raw, _ = found.get(tag, (0, b"", 0))
        return raw.split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else ""

    if name := camera(text(main, _MAKE), text(main, _MODEL)):
        meta["exif.camera"] = name
    more = below(_EXIF)
    for tag in _TAKEN:
        if "exif.taken" not in meta:
            try:
                meta["exif.taken"] = datetime.strptime(text(more, tag).strip(), "%Y:%m:%d %H:%M:%S").isoformat()
            except ValueError:
                pass
    gps = below(_GPS)
    lat, lon = _degrees(gps, 2, order, "S"), _degrees(gps, 4, order, "W")
    known = lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180 and (lat, lon) != (0, 0)
    return meta | {"exif.has_gps": "true" if known else "false"} | ({"exif.lat": f"{lat:.5f}", "exif.lon": f"{lon:.5f}"} if known else {})


# ---------------------------------------------------------------------- videos
def _boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, content) of the boxes in sequence, up to the first that does not fit."""
    at = 0
    while at + 8 <= len(data):
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = len(data) - at
        if size < head or at + size > len(data):
            return
        yield data[at + 4 : at + 8], data[at + head : at + size]
        at += size


def video(data: bytes) -> dict[str, str]:
    """The time a video was made, in UTC."""
    index = next((x for kind, x in _boxes(memoryview(data)) if kind == b"moov"), b"")
    head = bytes(next((x for kind, x in _boxes(index) if kind == b"mvhd"), b"")[:12]) if len(index) <= MAX_INDEX else b""
    width = {0: 4, 1: 8}.get(head[0] if head else -1)
    if width is None or len(head) < 4 + width:
        return {}
    seconds = int.from_bytes(head[4 : 4 + width], "big") - MAC_EPOCH
    if not 0 <= seconds <= 253_402_300_799:
        return {}
    return {"video.date": datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%S")}


# ------------------------------------------------------------------- all files
def one(data: bytes | None, ext: str | None, max_bytes: int, most: int) -> tuple[str, str | None, dict[str, str]]:
    """(status, text, metadata) of one file; ``ext`` in lower case."""
    if ext not in (*IMAGES, *VIDEOS, *OFFICE):
        return "unsupported", None, {}
    if data is None:
        return "vanished", None, {}
    large = len(data) > max_bytes
    try:
        if ext in OFFICE:
            text, meta = (None, {}) if large else office(data, ext, most)
        else:
            text, meta = None, image(data) if ext in IMAGES else video(data)
    except Unreadable as e:
        return str(e), None, {}
    return "too_large" if large else "ok", text, meta


def extract(files: DataFrame, content_col: str = "content", ext_col: str = "ext", out_col: str = "extracted", max_bytes: int = 100 << 20, max_chars: int = 200_000) -> DataFrame:
    """``files`` with a struct (status, text, meta) in place of its bytes; ``meta`` is a map of strings."""
    entry = pa.struct([("key", pa.string()), ("value", pa.string())])

    @F.arrow_udf("status string, text string, meta array<struct<key: string, value: string>>")
    def run(contents: pa.Array, exts: pa.Array) -> pa.Array:
        rows = [one(c.as_buffer().to_pybytes() if c.is_valid else None, e.as_py(), max_bytes, max_chars) for c, e in zip(contents, exts, strict=True)]
        meta = pa.array([[{"key": k, "value": v} for k, v in sorted(m.items())] for _, _, m in rows], type=pa.list_(entry))
        return pa.StructArray.from_arrays([pa.array([s for s, _, _ in rows], pa.string()), pa.array([t for _, t, _ in rows], pa.string()), meta], names=["status", "text", "meta"])

    found = run(F.col(f"`{content_col}`"), F.lower(F.col(f"`{ext_col}`")))
    kept = [F.col(f"`{c}`") for c in files.columns if c not in (content_col, out_col)]
    made = F.col("_found")
    done = F.struct(made["status"].alias("status"), made["text"].alias("text"), F.map_from_entries(made["meta"]).alias("meta"))
    return files.withColumn("_found", found).select(*kept, done.alias(out_col))
