"""TIFF pages in binary columns.

The reader walks the chain of image directories of a little- or big-endian
file, reads strips or tiles stored plain, as PackBits, LZW or deflate, undoes
the horizontal predictor, and gives one row for each page. The writer stores
samples of 8 bits as deflate strips with the horizontal predictor.

``pack_texts`` stores texts losslessly as images: the UTF-8 bytes, padded with
spaces to a positive multiple of ``ROW_BYTES``, are the samples of an RGB image
of 64 pixels a row.

Defined results: a null file has no pages; a file that is no TIFF, is cut short
or uses what isn't supported gives one row with ``page`` -1 and the reason in
``error``, and a broken later page gives the pages before it and that row. A
null text is empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .memory import in_arrow

ROW_BYTES, SAMPLES = 192, 3
#: Most bytes of an unpacked page: what a binary column can hold.
MAX_PAGE_BYTES = (1 << 31) - 1
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: The tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES_TAG, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = (
    256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325,
)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x width x samples


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a count n from 0 copies n + 1 bytes, one from 129 repeats the next byte 257 - n times."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n == 128:
            i += 1
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while i + run < len(data) and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first, wider one code early; 256 clears, 257 ends."""
    out = bytearray()
    table: list[bytes] = []
    width, last, value, bits = 9, b"", 0, 0
    for byte in data:
        value, bits = (value << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = value >> bits
        value &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if not table:
            raise ValueError("LZW data don't start with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("an LZW code is out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        if len(out) >= size:
            break
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    value = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal value, bits
        value, bits = (value << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(value >> bits)
            value &= (1 << bits) - 1

    fresh = {bytes((i,)): i for i in range(256)}
    table, width, now = dict(fresh), 9, b""
    put(256, 9)
    following = 258
    for i in range(len(data)):
        byte = data[i : i + 1]
        if now + byte in table:
            now += byte
            continue
        put(table[now], width)
        table[now + byte] = following
        following += 1
        if following == 4094:
            put(256, width)
            table, following = dict(fresh), 258
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        now = byte
    if now:
        put(table[now], width)
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257, width)
    if bits:
        out.append((value << (8 - bits)) & 255)
    return bytes(out)


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == 1:
        out = data[:size]
    elif compression == 5:
        out = lzw_decode(data, size)
    elif compression in (8, 32946):
        out = zlib.decompressobj().decompress(data, size)
    elif compression == 32773:
        out = unpack_bits(data, size)
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(out) < size:
        raise ValueError(f"{len(out)} of {size} bytes of a strip or tile")
    return out


def read_pages(data: bytes, most: int = MAX_PAGE_BYTES) -> Iterator[Page]:
    """The pages of a TIFF file of 8-bit samples; one of more than ``most`` bytes is a ValueError."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("a directory's place is wrong")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * count > len(data):
            raise ValueError("a directory is cut short")
        tags: dict[int, list[int]] = {}
        for i in range(count):
            tag, kind, n, inline = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", inline)[0]
            if kind in (1, 3, 4) and size and place + size <= len(data):
                tags[tag] = list(struct.unpack_from(f"{order}{n}{'_BxHI'[kind]}", data, place))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
        yield _page(data, tags, most)


def _page(data: bytes, tags: dict[int, list[int]], most: int) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES_TAG, 1)
    compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if width < 1 or height < 1 or samples < 1 or set(tags.get(BITS, [1])) != {8} or predictor not in (1, 2):
        raise ValueError("only samples of 8 bits, plain or with the horizontal predictor")
    if width * height * samples > most:
        raise ValueError("a page is too large")
    depth, planes = (samples, 1) if planar == 1 else (1, samples)
    out = np.empty((height, width, samples), dtype=np.uint8)
    tiled = TILES in tags
    places, sizes = tags.get(TILES if tiled else STRIPS, []), tags.get(TILE_BYTES if tiled else STRIP_BYTES, [])
    w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS, height), height))
    if w < 1 or h < 1:
        raise ValueError("a strip or tile has no size")
    across, down = -(-width // w), -(-height // h)
    if len(places) != across * down * planes or len(sizes) != len(places):
        raise ValueError("the number of strips or tiles is wrong")
    for i, (place, size) in enumerate(zip(places, sizes, strict=True)):
        plane, rest = divmod(i, across * down)
        y, x = (v * s for v, s in zip(divmod(rest, across), (h, w), strict=True))
        rows = h if tiled else min(h, height - y)
        if place + size > len(data):
            raise ValueError("a strip or tile is cut short")
        part = np.frombuffer(_unpacked(data[place : place + size], compression, rows * w * depth), dtype=np.uint8).reshape(rows, w, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        target = out[y : y + rows, x : x + w]
        part = part[: target.shape[0], : target.shape[1]]
        if planes == 1:
            target[:] = part
        else:
            target[:, :, plane] = part[:, :, 0]
    return Page(width, height, samples, compression, predictor, out)


def write_page(pixels: np.ndarray, rows_per_strip: int = 256, level: int = 1) -> bytes:
    """One page of height x width x samples (1 or 3), deflate strips with the horizontal predictor, little-endian."""
    height, width, samples = pixels.shape
    delta = pixels.copy()
    delta[:, 1:] -= pixels[:, :-1]
    strips = [zlib.compress(delta[y : y + rows_per_strip].tobytes(), level) for y in range(0, height, rows_per_strip)]
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    ends = np.cumsum([8] + [len(s) for s in strips])
    tags = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]),
        (STRIPS, 4, ends[:-1].tolist()), (SAMPLES_TAG, 3, [samples]), (ROWS, 4, [rows_per_strip]), (STRIP_BYTES, 4, [len(s) for s in strips]),
        (PLANAR, 3, [1]), (PREDICTOR, 3, [2]),
    ]
    at = 8 + len(body)
    free = at + 2 + 12 * len(tags) + 4
    entries, extra = b"", b""
    for tag, kind, values in tags:
        packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(packed) > 4:
            inline = struct.pack("<I", free + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            inline = packed.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + inline
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


def text_pixels(raw: bytes) -> np.ndarray:
    """Bytes, padded with spaces, as rows of 64 RGB pixels."""
    size = max(ROW_BYTES, -(-len(raw) // ROW_BYTES) * ROW_BYTES)
    return np.frombuffer(raw.ljust(size, b" "), dtype=np.uint8).reshape(-1, ROW_BYTES // SAMPLES, SAMPLES)


def feature(pixels: np.ndarray) -> str:
    """16 hex digits: which cells of an 8 x 8 grid of mean brightness are above the grid's median, row by row."""
    height, width, _ = pixels.shape
    sums = np.zeros((height + 1, width + 1))
    sums[1:, 1:] = pixels.sum(axis=2, dtype=np.float64).cumsum(axis=0).cumsum(axis=1)
    ys, xs = (np.arange(9) * n // 8 for n in (height, width))
    y0, y1, x0, x1 = ys[:-1], np.minimum(np.maximum(ys[1:], ys[:-1] + 1), height), xs[:-1], np.minimum(np.maximum(xs[1:], xs[:-1] + 1), width)
    cells = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    cells /= np.outer(y1 - y0, x1 - x0)
    return np.packbits(cells.ravel() > np.median(cells)).tobytes().hex()


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each text as a TIFF file of one page."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                raws = part.column(1)
                media = [write_page(text_pixels(x.as_py())) for x in raws]
                sizes = pa.array([len(x.as_buffer() or b"") for x in raws], type=pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(media, type=pa.binary())], names=["id", "n_bytes", "media"])

    return in_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


PAGES = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, feature string, error string"


def decode_pages(files: DataFrame, media_col: str = "media", max_page_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """The columns of ``files`` (but those of ``PAGES``) with one row for each page; ``max_page_bytes`` guards against files that unfold."""
    names = [x.split()[0] for x in PAGES.split(", ")]
    files = files.select(*(F.col(f"`{c}`") for c in files.columns if c not in names))
    kept_names = files.columns
    at = kept_names.index(media_col)
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                rows, found = [], []
                for i in range(batch.num_rows):
                    data = batch.column(at)[i].as_py()
                    if data is None:
                        continue
                    try:
                        for number, p in enumerate(read_pages(bytes(data), max_page_bytes)):
                            rows.append(i)
                            found.append((number, p.width, p.height, p.samples, p.compression, p.predictor, p.pixels.tobytes(), feature(p.pixels), None))
                    except (ValueError, zlib.error, struct.error) as e:
                        rows.append(i)
                        found.append((-1, *[None] * 7, str(e)))
                kept = batch.take(pa.array(rows, type=pa.int64()))
                new = [pa.array([f[k] for f in found], type=kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*kept_names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return in_arrow(files, run, f"{schema}, {PAGES}")
