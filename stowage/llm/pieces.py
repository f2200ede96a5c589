"""SentencePiece BPE encoding and decoding by suffix-array matching.

A batch's distinct chunks (runs that no piece crosses) are concatenated and
indexed by a suffix array; every piece of the vocabulary is binary-searched in
it, all pieces at once, which gives the range of its occurrences. The ranges
become edges (position, length, piece), sorted by position, and the edges are
relaxed in the model's own order: of a chunk's edges that join two adjacent
symbols, the one with the best score, leftmost at a tie, replaces them, until
none is left. Characters that stay without a piece become byte pieces.

A position that no piece spans parts a chunk into runs, which are relaxed on
their own; so a chunk of any length is taken window by window, and only a run
without such a position (a single character repeated, say) is held as a whole,
with about 100 bytes for each character.

The model file is parsed here (a few protobuf fields); it must be a BPE model
with byte fallback and the identity normaliser, others raise ValueError. The
path of the model file is a parameter; the file's content is broadcast, and
it is at most ``MODEL_BYTES``.

Defined results: null gives null ids and null text; an empty text has no ids.
Decoding restores the text, but U+2581 (the mark that stands for a space in
pieces) comes back as a space, as in the public format.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .memory import in_arrow
from .words import slices

MODEL_BYTES = 16 << 20
SPACE = "▁"
#: Characters of chunks that are indexed together; a longer chunk is indexed window by window.
BATCH_CHARS = 200_000
#: Bytes of text that are encoded together.
SLICE = 1 << 20
#: Runs up to this length are relaxed together, column by column; longer ones with a heap.
LONG_CHUNK = 48
#: Characters of chunks whose ids a worker keeps.
KNOWN_CHARS = 3_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[i]
            out |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return out, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 1:
            value, i = data[i : i + 8], i + 8
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            value, i = data[i : i + 4], i + 4
        yield tag >> 3, value


class Model:
    """A SentencePiece BPE model: pieces, scores, types, normaliser flags."""

    def __init__(self, blob: bytes):
        if len(blob) > MODEL_BYTES:
            raise ValueError(f"a model of {len(blob)} bytes is larger than {MODEL_BYTES}")
        self.pieces: list[str] = []
        scores, kinds = [], []
        self.dummy_prefix, kind, identity = True, 1, True
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, 1))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                identity = not spec.get(2) and not spec.get(4, 1)
                self.dummy_prefix = bool(spec.get(3, 1))
        self.kinds = np.array(kinds)
        self.bytes_at = {int(self.pieces[i][3:5], 16): i for i in np.flatnonzero(self.kinds == 6)}
        if kind != 2 or not identity or len(self.bytes_at) != 256:
            raise ValueError("only BPE models with byte fallback that keep the text as it is")
        normal = [i for i in range(len(kinds)) if kinds[i] == 1]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece goes on after a space")
        order = sorted(normal, key=lambda i: -scores[i])
        rank = {i: r for r, i in enumerate(order)}  # equal scores: the smaller id first
        self.by_rank = np.array(order, dtype=np.int32)
        # pieces of two characters and more for the index, single ones by code point
        self.single = {self.pieces[i]: i for i in normal if len(self.pieces[i]) == 1}
        several = [i for i in normal if len(self.pieces[i]) > 1]
        self.longest = max(map(len, self.pieces))
        self.lengths = np.array([len(self.pieces[i]) for i in several])
        self.ranks = np.array([rank[i] for i in several], dtype=np.int32)
        self.codes = np.zeros((len(several), self.longest), dtype=np.int32)
        for row, i in enumerate(several):
            self.codes[row, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        self.top = int(self.codes.max(initial=0))
        self.plain = [p.replace(SPACE, " ") if kinds[i] == 1 else "" for i, p in enumerate(self.pieces)]

    def fallback(self, char: str) -> list[int]:
        got = self.single.get(char)
        return [got] if got is not None else [self.bytes_at[b] for b in char.encode()]


class Index:
    """A text's suffix array: positions sorted by their next ``depth`` values at least.

    Values are renumbered without gaps; the first sort key packs as many of
    them as fit into 62 bits, then ranks double.
    """

    def __init__(self, codes: np.ndarray, depth: int, top: int):
        n = len(codes)
        present = np.zeros(max(int(codes.max(initial=0)), top) + 1, dtype=np.int64)
        present[codes] = 1
        self.number = np.cumsum(present) * present  # from 1, in the order of the codes; 0 is absent
        dense = self.number[codes]
        self.bits = int(dense.max(initial=1)).bit_length()
        self.width = width = min(62 // self.bits, depth)
        self.codes = codes
        first = key = np.zeros(n, dtype=np.int64)
        for i in range(width):
            key <<= self.bits
            key[: max(0, n - i)] |= dense[i:]
        while True:
            order = np.argsort(key)
            if width >= depth:
                break
            sorted_key = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
            key = rank * (n + 2)
            if width < n:
                key[:-width] += rank[width:]
            width *= 2
        self.order, self.keys = order, first[order]

    def occurrences(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open ranges of ``order`` whose suffixes start with each pattern (rows, zero-padded).

        A binary search of the keys finds what fits into one; a second one,
        over the characters, goes on within the ranges of longer patterns.
        """
        inside = np.arange(patterns.shape[1])[None, :] < lengths[:, None]
        dense = self.number[patterns]
        known = (dense > 0) | ~inside
        packed = np.zeros(len(patterns), dtype=np.int64)
        for i in range(self.width):
            packed = (packed << self.bits) | (np.where(inside[:, i], dense[:, i], 0) if i < patterns.shape[1] else 0)
        free = self.bits * np.maximum(self.width - lengths, 0)
        low, high = np.searchsorted(self.keys, packed), np.searchsorted(self.keys, packed + (np.int64(1) << free))
        high = np.where(known.all(axis=1), high, low)
        long = np.flatnonzero((lengths > self.width) & (low < high))
        if len(long):
            low[long], high[long] = (self._bound(patterns[long], inside[long], low[long], high[long], upper) for upper in (False, True))
        return low, high

    def _bound(self, patterns: np.ndarray, inside: np.ndarray, low: np.ndarray, high: np.ndarray, upper: bool) -> np.ndarray:
        columns = np.arange(patterns.shape[1])
        padded = np.concatenate([self.codes, np.zeros(patterns.shape[1], self.codes.dtype)])
        low, high = low.copy(), high.copy()
        while (left := np.flatnonzero(low < high)).size:
            middle = (low[left] + high[left]) >> 1
            text = padded[self.order[middle][:, None] + columns[None, :]]
            differ = (text != patterns[left]) & inside[left]
            at, rows = differ.argmax(axis=1), np.arange(len(left))
            equal = ~differ[rows, at]
            right = (text[rows, at] < patterns[left, at]) & ~equal
            if upper:
                right |= equal
            low[left] = np.where(right, middle + 1, low[left])
            high[left] = np.where(right, high[left], middle)
        return low


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        #: Ids of chunks met lately; ``KNOWN_CHARS`` of them, and all are forgotten.
        self.known: dict[str, bytes] = {}
        self.known_chars = 0
        self.kind = np.uint16 if len(model.by_rank) < 65535 else np.int32
        self.none = self.kind(np.iinfo(self.kind).max)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``[position, length]`` -> rank of the piece there (no piece is the largest value), and the joints: whether a piece spans each position and the one before it."""
        m = self.model
        index = Index(codes, m.longest, m.top)
        low, high = index.occurrences(m.codes, m.lengths)
        counts = high - low
        at = index.order[np.repeat(low, counts) + _ranges(counts)]
        lengths = np.repeat(m.lengths, counts)
        out = np.full((len(codes), m.longest + 1), self.none, dtype=self.kind)
        out[at, lengths] = np.repeat(m.ranks, counts)
        n = len(codes) + 1
        return out, np.cumsum(np.bincount(at + 1, minlength=n) - np.bincount(at + lengths, minlength=n))[: len(codes)] > 0

    def _relaxed(self, edges: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the symbols that are left of each run of characters, all runs together."""
        short = np.flatnonzero(sizes <= LONG_CHUNK)
        owner = np.repeat(short, sizes[short])
        begin = np.repeat(begins[short], sizes[short]) + _ranges(sizes[short])
        end = begin + 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(begin):
            same = np.append(owner[1:] == owner[:-1], False)
            width = np.append(end[1:] - begin[:-1], 0)
            fits = same & (width <= self.model.longest)
            rank = np.where(fits, edges[begin, np.where(fits, width, 0)], self.none)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, heads)
            length = np.diff(np.append(heads, len(owner)))
            live = best != self.none
            if not live.all():
                over = np.repeat(~live, length)
                done.append((begin[over], end[over]))
            spread = np.repeat(best, length)
            at = np.flatnonzero((rank == spread) & (spread != self.none))
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])] if len(at) else at
            end[at] = end[at + 1]
            keep = np.repeat(live, length)
            keep[at + 1] = False
            owner, begin, end = owner[keep], begin[keep], end[keep]
        for k in np.flatnonzero(sizes > LONG_CHUNK).tolist():
            first = self._heap(edges[begins[k] : begins[k] + sizes[k]]) + begins[k]
            done.append((first, np.append(first[1:], begins[k] + sizes[k])))
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, end = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(begin)
        return begin[order], end[order]

    def _heap(self, edges: np.ndarray) -> np.ndarray:
        """Begins of the symbols of one long run: a heap of its joinable pairs by (rank, position), packed into integers."""
        n, longest, none = len(edges), self.model.longest, int(self.none)
        after = array("q", range(1, n + 1))  # end of the symbol that starts here
        before = array("q", range(-1, n - 1))  # start of the symbol before the one that starts here
        alive = bytearray(b"\1") * n

        def pair(b: int) -> int:
            """(rank, position, width) of the symbol that starts here and the next one; -1 if no piece joins them."""
            e = after[b]
            if e >= n or after[e] - b > longest or (r := int(edges[b, after[e] - b])) == none:
                return -1
            return (r << 40 | b) << 8 | (after[e] - b)

        heap = [(r << 40 | b) << 8 | 2 for b, r in enumerate(edges[:, 2].tolist()) if r != none and b + 2 <= n]
        heapify(heap)
        while heap:
            found = heappop(heap)
            b, width = found >> 8 & (1 << 40) - 1, found & 255
            if not alive[b] or after[b] >= n or after[after[b]] - b != width:
                continue
            e = after[b]
            alive[e] = 0
            after[b] = after[e]
            if after[b] < n:
                before[after[b]] = b
            for x in (before[b], b):
                if x >= 0 and (q := pair(x)) >= 0:
                    heappush(heap, q)
        return np.flatnonzero(np.frombuffer(alive, dtype=np.uint8))

    def _ids(self, codes: np.ndarray, edges: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all symbols, and where each symbol's ids start; one of one character has the ids of its fallback, up to four."""
        chars, which = np.unique(codes, return_inverse=True)
        spelt = [self.model.fallback(chr(c)) for c in chars.tolist()]
        table = np.zeros((len(spelt), 4), dtype=np.int32)
        for row, ids in enumerate(spelt):
            table[row, : len(ids)] = ids
        widths = np.array([len(ids) for ids in spelt])
        one = end - begin == 1
        counts = np.where(one, widths[which[begin]], 1)
        flat = table[np.repeat(which[begin], counts), _ranges(counts)]
        firsts = np.cumsum(counts) - counts
        several = np.flatnonzero(~one)
        flat[firsts[several]] = self.model.by_rank[edges[begin[several], (end - begin)[several]]]
        return flat.astype(np.int32), firsts

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, as the bytes of 32-bit integers."""
        codes = np.frombuffer("\0".join(chunks).encode("utf-32-le"), dtype=np.int32)
        sizes = np.array([len(c) for c in chunks])
        heads = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        # a NUL within a chunk is a character without a piece, as the separator is
        edges, joined = self.edges(codes)
        outside = np.zeros(len(codes) + 1, dtype=bool)
        outside[(heads + sizes)[:-1]] = True
        # no piece crosses the start of a run, so runs are relaxed on their own
        begins = np.flatnonzero(~joined & ~outside[:-1])
        ends = np.append(begins[1:], len(codes))
        begin, end = self._relaxed(edges, begins, ends - outside[ends - 1] - begins)
        flat, firsts = self._ids(codes, edges, begin, end)
        raw = flat.tobytes()
        cuts = (np.append(firsts[np.searchsorted(begin, heads)], len(flat)) * 4).tolist()
        return [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_long(self, chunk: str) -> bytes:
        """Ids of a long chunk, window by window; each ends where no piece crosses, beyond which no piece of it reaches."""
        m, out, low, width = self.model, [], 0, BATCH_CHARS
        while low < len(chunk):
            codes = np.frombuffer(chunk[low : low + width].encode("utf-32-le"), dtype=np.int32)
            edges, joined = self.edges(codes)
            begins = np.flatnonzero(~joined)
            stop = len(codes)
            if low + stop < len(chunk):
                # pieces that start in the last places may go on after the window
                inner = begins[begins <= stop - m.longest]
                if len(inner) < 2:
                    width *= 2
                    continue
                begins, stop = inner[:-1], int(inner[-1])
            begin, end = self._relaxed(edges, begins, np.append(begins[1:], stop) - begins)
            out.append(self._ids(codes, edges, begin, end)[0].tobytes())
            low, width = low + stop, BATCH_CHARS
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text, as the bytes of 32-bit integers."""
        if self.known_chars > KNOWN_CHARS:
            self.known, self.known_chars = {}, 0
        known = self.known
        split = [None if text is None else chunks_of(text, self.model.dummy_prefix) for text in texts]
        new = set().union(*filter(None, split)).difference(known)
        long = [c for c in new if len(c) > BATCH_CHARS]
        waiting: list[str] = []
        size = 0
        for c in [*new.difference(long), None]:
            if c is not None:
                waiting.append(c)
                size += len(c) + 1
            if waiting and (c is None or size > BATCH_CHARS):
                known.update(zip(waiting, self.encode_chunks(waiting), strict=True))
                self.known_chars += size
                waiting, size = [], 0
        for c in long:
            known[c] = self.encode_long(c)
        out = [None if chunks is None else b"".join([known[c] for c in chunks]) for chunks in split]
        for c in long:
            del known[c]
        return out

    def decode(self, ids: list[int]) -> str:
        m, out, raw = self.model, [], bytearray()
        low = m.bytes_at[0]
        for i in ids:
            if m.kinds[i] == 6:
                raw.append(i - low)
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(m.plain[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        text = "".join(out)
        return text[1:] if m.dummy_prefix and text[:1] == " " else text


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def chunks_of(text: str, dummy_prefix: bool = True) -> list[str]:
    """The text with marks for spaces, cut before each mark that follows another character."""
    if not text:
        return []
    text = (" " if dummy_prefix else "") + text.replace(SPACE, " ")
    parts = text.split(" ")
    out: list[str] = []
    marks = ""
    head = parts[0]
    if "" not in parts[1:]:
        out = [SPACE + part for part in parts[1:]]
        return [head, *out] if head else out
    if head:
        out.append(head)
    for part in parts[1:]:
        marks += SPACE
        if part:
            out.append(marks + part)
            marks = ""
    if marks:
        out.append(marks)
    return out


def load_model(path: str) -> bytes:
    """The model file's bytes, read on the driver."""
    return Path(path).read_bytes()


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids (array<int>) of ``text_col`` in ``ids_col`` (a column of that name is replaced)."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != ids_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            encoder = encoder or Encoder(Model(shared.value))
            sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy()
            for low, high in slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), SLICE):
                part = whole.slice(low, high - low)
                ids = encoder.encode(part.column(at).to_pylist())
                ends = np.cumsum([0] + [len(x or b"") // 4 for x in ids])
                none = pa.array([x is None for x in ids])
                values = pa.array(np.frombuffer(b"".join([x or b"" for x in ids]), dtype=np.int32))
                column = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values, mask=none)
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, ids_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_arrow(docs, run, f"{schema}, `{ids_col}` array<int>")


def decode_documents(docs: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array of ids in ``text_col``.

    Every piece has its bytes in hexadecimal; joined, they are the text's
    UTF-8, whose faulty parts become U+FFFD.
    """
    m = Model(model)
    low = m.bytes_at[0]
    spelt = [f"{i - low:02x}" if kind == 6 else p.encode().hex() for i, (p, kind) in enumerate(zip(m.plain, m.kinds.tolist(), strict=True))]
    table = F.split(F.lit(",".join(spelt)), ",")  # folded to one constant
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform(F.col(ids_col), lambda i: F.get(table, i)), "")).cast("string"))
    if m.dummy_prefix:
        text = F.when(F.startswith(text, F.lit(" ")), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    return docs.withColumn(text_col, text)
