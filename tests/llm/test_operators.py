"""Operators against brute force, exact round trips and held-out accuracy, edge cases included."""

import hashlib
import io
import math
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from stowage.llm import chat, components, decontam, html_text, lang_id, line_dedup, near_dup, pieces, pii, queries, tiff, warc

LONG = "wort " * 20_000 + "x" * 50_000
TEXTS = [
    None, "", "   \n\t ", "one", "one two", "One TWO", "a b c d e f g h", "a b c d e f g h", "a b c d e f g x", LONG, LONG + "y",
    "mail a@b.c_d@e.f or x@y.z, ip 1.2.3.4.5.6.7.8 and 300.1.1.1", "card 4111 1111 1111 1111 x 4111111111111112 phone +49 (30) 123-4567 +1",
    "\u00c4\u00d6 \u4f60\u597d \U0001f600 tab\there", "9" * 5000 + " " + "1 " * 3000, "@@@ a@ @b a@b", "0.0.0.0 255.255.255.255 256.1.1.1 1.2.3",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 1) for i, t in enumerate(TEXTS)] + [(None, "a b c", None, None, None), (6, TEXTS[6], "en", "s", 1)]
    extra = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("n", T.IntegerType())])
    return spark.createDataFrame(rows, extra)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80), (2, 90)])
def test_near_duplicates(docs, size, percent):
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, words=size, percent=percent).collect()}
    assert got == brute.near_duplicates(rows_of(docs), size, percent)


def test_near_duplicates_of_nothing(empty):
    assert near_dup.near_duplicates(empty).collect() == []


def test_near_duplicates_around_hubs(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [[r.choice(words) for _ in range(200)] for _ in range(3)]
    rows = []
    for i in range(300):
        t = list(base[i % 3])
        for _ in range(r.randrange(9)):
            t[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = {x.id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == brute.near_duplicates(rows, 3, 85)


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], r.integers(0, 2**63, 80).astype(np.uint64)])
    out = near_dup.sketch(np.concatenate([a, b]), np.repeat([0, 1], 400), 2, bins=2048)
    assert (out != np.uint64(2**64 - 1)).all()
    assert abs((out[0] == out[1]).mean() - 320 / 480) < 0.05


def test_near_duplicates_of_rows_that_repeat_an_id(spark):
    """Of an id's texts the one with the smallest set counts, alone."""
    base = [f"w{i}" for i in range(60)]
    near, far = " ".join(base), " ".join(f"v{i}" for i in range(80))
    rows = [(1, near), (2, near + " x"), (2, far), (3, far), (3, far), (4, far + " y"), (5, near + " z"), (5, near + " z z z z z z z z z z z z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame, words=3, percent=85).collect()}
    assert got == {1: (58, 1), 2: (59, 1), 3: (78, 3), 4: (79, 3), 5: (59, 1)}


def test_near_duplicates_with_shared_boilerplate(spark):
    """Pages alike by three quarters share all buckets but make no pair; links among them are still found."""
    words = [f"b{i}" for i in range(122)]
    rows = [(i, " ".join([*words, *(f"o{i}x{k}" for k in range(20))])) for i in range(400)]
    rows += [(1000 + i, rows[7 * i][1] + " more") for i in range(20)] + [(2000 + i, " ".join([*words, *(f"s{i // 2}x{k}" for k in range(20 + i % 2))])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for words_, percent in ((3, 85), (5, 80)):
        got = {r.id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame, words=words_, percent=percent).collect()}
        assert got == brute.near_duplicates(rows, words_, percent)


def test_sketch_filter_and_bands_keep_links():
    """Pairs at the threshold: the share that shares a band and agrees in enough bins."""
    r = np.random.default_rng(3)
    for percent, size in ((80, 450), (85, 370)):
        bins = near_dup.ROWS * near_dup.BANDS
        least = near_dup.least_bins(percent)
        both, own = size * 2 * percent // (100 + percent), size - size * 2 * percent // (100 + percent)
        values, rows = [], []
        for k in range(400):
            common = r.integers(0, 2**63, both).astype(np.uint64)
            for j in (0, 1):
                values += [common, r.integers(0, 2**63, own).astype(np.uint64)]
                rows.append(np.full(both + own, 2 * k + j))
        out = near_dup.sketch(np.concatenate(values), np.concatenate(rows), 800)
        keys = near_dup.band_keys(out)
        assert ((out[::2] == out[1::2]).sum(axis=1) >= least).all() and (keys[::2] == keys[1::2]).any(axis=1).all()
        share = percent / 100
        assert sum(math.comb(bins, k) * share**k * (1 - share) ** (bins - k) for k in range(least)) < 1e-7


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(0, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 560)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_pieces_like_the_library(spark, docs):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.MODEL_PATH)
    model = pieces.load_model(queries.MODEL_PATH)
    r = random.Random(2)
    odd = ["  two  spaces ", "a\0b", "in.the.of/" * 60, "\u65e5\u672c " * 30, "x" * 500] + ["".join(r.choice("aeinorst \n.\u00e9\u4f60") for _ in range(r.randrange(200))) for _ in range(200)]
    encoder = pieces.Encoder(pieces.Model(model))
    for text, ids in zip(odd, encoder.encode(odd), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text)
        assert encoder.decode(np.frombuffer(ids, np.int32).tolist()) == text
    got = pieces.decode_documents(pieces.encode_documents(docs, model), model).collect()
    assert all(x.decoded == x.text and (x.text is None) == (x.ids is None) for x in got)
    assert all(list(x.ids) == library.encode(x.text) for x in got if x.text is not None)
    assert pieces.encode_documents(docs.limit(0), model).count() == 0


def test_pieces_mark_becomes_a_space(spark):
    model = pieces.load_model(queries.MODEL_PATH)
    row = pieces.decode_documents(pieces.encode_documents(spark.createDataFrame([("a\u2581b",)], "text string"), model), model).first()
    assert row.decoded == "a b"


def test_languages_held_out(spark, sf_dir):
    got = queries.op3_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_edges(docs, empty):
    got = {r.doc_id: r["_language"] for r in lang_id.identify(docs).collect()}
    assert got[0].lang == got[1].lang == got[2].lang == got[14].lang == "und" and got[0].score == 0
    assert got[3].lang == "en"
    assert lang_id.identify(empty).collect() == []
    assert {r["_language"].lang for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\<|im_end|>\n", "<|im_start|>user\n\\", "", None, "<<|im_end|>|im_end|>\n", LONG]
    rows = [(c, t, role, text) for c, (role, text) in enumerate((r, s) for r in ("user", "assistant", "odd\nrole", None) for s in said) for t in (2, 1)]
    frame = spark.createDataFrame([*rows, (None, None, None, None), (0, 1, "user", said[0])], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(chat.canonical(frame.withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x")))).withColumn("turns", chat.parse_turns(F.col("formatted"))).collect()
    want = {}
    for c, t, role, text in sorted([*rows, (-1, 0, "", ""), (0, 1, "user", said[0])], key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {-1 if r.conv_id is None else r.conv_id: [(t.role, t.text) for t in r.turns] for r in done} == want
    for r in done:
        lost = ["".join(c if k % 2 else c.replace("\\", "") for k, c in enumerate(re.split(r"\\(.)", r.formatted[s.start : s.end], flags=re.S))) for s in r.loss_mask]
        assert lost == [t.text for t in r.turns if t.role == "assistant"]
    assert chat.canonical(frame.limit(0)).count() == 0
    alone = chat.canonical(spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "b")], frame.schema)).collect()
    assert sorted(r.turns[0].text for r in alone) == ["a", "b"] and all(r.conv_id is None and len(r.turns) == 1 for r in alone)


def test_chat_fingerprint_selects_the_mapping(spark):
    """One conversation in tables of five layouts; the schema's hash alone tells how each is read."""
    turns = [("user", "q"), ("assistant", "a")]
    said = "array<struct<{}:string,{}:string>>"
    tables = [
        spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string"),
        spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conversation_id long, position long, sender string, content string"),
        spark.createDataFrame([(1, turns)], f"conv_id long, messages {said.format('role', 'content')}"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], f"conv_id long, conversations {said.format('from', 'value')}"),
        spark.createDataFrame([(1, "q", "a", "x")], "conv_id long, prompt string, response string, other string"),
        spark.createDataFrame([(1, "q", None, "a")], "conv_id long, instruction string, input string, output string"),
    ]
    names = ["turn rows", "turn rows with sender", "messages", "conversations", "prompt and response", "instruction with input"]
    for table, name in zip(tables, names, strict=True):
        besides = ("conv_id",) if "turn" not in table.columns else ()
        assert chat.layout_of(table, besides).name == name
        assert [(r.conv_id, [tuple(t) for t in r.turns]) for r in chat.canonical(table, besides=besides).collect()] == [(1, turns)]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(tables[0].drop("role"))


def test_chat_layouts(spark):
    import json

    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"instruction": "do", "input": "q", "output": "a"}, {"who": "knows"},
    ]
    frame = spark.createDataFrame([(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(6, None, "x"), (7, "{broken", "x")], "id int, record string, layout string")
    got = {r.id: r for r in chat.canonical_records(frame).collect()}
    assert [[(t.role, t.text) for t in got[i].turns] for i in range(4)] == [[("user", "q"), ("assistant", "a")]] * 4
    assert got[4].turns[0].text == "do\n\nq"
    assert all(got[i].layout is None and got[i].turns is None for i in (5, 6, 7)) and got[5].layout_fingerprint


def test_lines(spark):
    r = random.Random(7)
    pool = [f"common line number {i} of the footer" for i in range(5)] + ["short", "", "Served in 12 ms by host 7", "a passage that is long " + "word " * 30]
    names = ["anna", "bob", "carl", "dora", "emil", "fritz", "gerd", "hans"]
    rows = []
    for i in range(60):
        lines = [r.choice(pool) for _ in range(r.randrange(4))] + [" ".join(r.choice("abcdefgh") * 3 for _ in range(r.randrange(9)))]
        lines.append(f"this page was written with much care by {names[i % 8]} for all of us")
        lines.append(f"Served in {r.randrange(99)} ms by host {i}")
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, LONG)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.template_lines(rows)
    assert {x.id: set(x.places) for x in line_dedup.dropped_lines(frame).collect()} == want
    done = {x.doc_id: x for x in line_dedup.drop_recurring_lines(frame.withColumn("places", F.lit(1)).withColumn("lines_dropped", F.lit("x"))).collect()}
    for i, text in rows:
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want.get(i, ()))
        assert done[i].text == kept and done[i].places == 1
    assert line_dedup.drop_recurring_lines(frame.limit(0)).count() == 0


def test_lines_of_rows_that_repeat_an_id(spark):
    """Each row loses lines of its own text only; a document counts once; other columns keep their names and values."""
    common, own = "one common line here", "quite unique first line"
    rows = [(1, common), (2, f"{common}\nx"), (2, f"{own}\n{common}"), (2, f"{own}\n{common}"), (3, f"{common}\n{common}"), (None, common), (4, None), (5, f"only here\nonly here"), (5, "only here\nand that")]
    names = ("_id", "_places", "_digest", "lines_dropped", "places", "digest", "line")
    frame = spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    done = line_dedup.drop_recurring_lines(frame, **line_dedup.WHOLE).collect()
    assert all(r[n] == k for r in done for k, n in enumerate(names) if n != "lines_dropped")
    want = [(1, common, 0), (2, "x", 1), (2, own, 1), (2, own, 1), (3, "", 2), (None, common, 0), (4, None, None), (5, rows[7][1], 0), (5, rows[8][1], 0)]
    assert sorted(((r.doc_id, r.text, r.lines_dropped) for r in done), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_lines_by_either_join(spark, monkeypatch, broadcast):
    monkeypatch.setattr("stowage.llm.shared.BROADCAST_KEYS", broadcast)
    rows = [(i, f"the footer of this page {'abcdefgh'[i % 8]} was made for all of us\nsame\n{i} own") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.id: set(x.places) for x in line_dedup.dropped_lines(frame).collect()} == brute.template_lines(rows)


def test_lines_of_numbers_recur_only_if_equal(spark):
    table = lambda i: "\n".join(["| item | count | price |", f"| {i} | {i * 7} | 3.{i} |", "12 45 99", f"{i}00 8 {i}77", f"2024-01-0{i} 10:0{i} ok", f"the footer of this page was made on day {i}"])
    rows = [(i, table(i) + "\n12 45 99") for i in range(1, 5)]
    long = " ".join(str(k) for k in range(30))
    rows += [(5, long), (6, long), (7, long + " 31"), (8, " ".join(str(k + 1) for k in range(30)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    # the heading, the equal row of numbers and the footer, which differs in one of nine tokens
    want = {1: {6}, 2: {0, 2, 5, 6}, 3: {0, 2, 5, 6}, 4: {0, 2, 5, 6}, 6: {0}}
    assert {x.id: set(x.places) for x in line_dedup.dropped_lines(frame, **line_dedup.WHOLE).collect()} == want
    docs = frame.selectExpr("doc_id", "text", "length(text) n_chars")
    kept = {x.doc_id: x.text.split("\n") for x in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert kept == {i: [x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ())] for i, t in rows if i != 6}


def test_short_lines_and_scripts_without_spaces(spark):
    notice = "\u672c\u7f51\u7ad9\u7248\u6743\u6240\u6709"
    passage, thai = "\u7248\u6743" * 20, "\u0e01\u0e02" * 40
    rows = [(i, f"{notice}\nRead more\nof.\nown{'abcd'[i]}\n\n  ") for i in range(4)]
    rows += [(4, f"{passage}\n{thai}\n{passage[:30]}\nRead less"), (5, f"{passage}\n{thai}\n{passage[:30]}\nRead less"), (6, f"{thai[:60]}\nx"), (7, f"{thai[:60]}\nx")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: {0, 1, 2}, 2: {0, 1, 2}, 3: {0, 1, 2}, 5: {0, 1}}
    assert {x.id: set(x.places) for x in line_dedup.dropped_lines(frame, **line_dedup.WHOLE).collect()} == want
    docs = frame.selectExpr("doc_id", "text", "length(text) n_chars")
    kept = {x.doc_id: x.text.split("\n") for x in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert kept == {i: [x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ())] for i, t in rows}


def test_short_lines_of_generated_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {x.id: set(x.places) for x in line_dedup.dropped_lines(frame, **line_dedup.WHOLE).collect()}
    assert got == brute.template_lines(rows_of(frame), min_tokens=1) != brute.template_lines(rows_of(frame))


def test_lines_of_generated_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {x.id: set(x.places) for x in line_dedup.dropped_lines(frame).collect()} == brute.template_lines(rows_of(frame))


def test_warc(spark):
    big = "<p>" + "\u00e4" * 600
    rows = [(1, "http://a/", big), (2, "http://b/\r\nx", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", "z" * 2000), (8, "u", LONG)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.id: r for r in warc.read_records(index).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        kind = ("revisit", 3) if i in (1, 2) else ("response", None)
        assert (got[i].record_type, got[i].refers_to) == kind
        assert (got[i].payload_bytes, got[i].digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[i].payload is None if kind[1] else bytes(got[i].payload) == raw
    some = warc.read_records(index.where("id in (4, 8)")).collect()
    assert {r.id for r in some} == {4, 8}
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    with pytest.raises(ValueError, match="cut short"):
        warc.parse_record(warc.record_bytes(1, "u", b"abc", "d", None)[:-6])


def test_pii_base_spans(docs, empty):
    got = {}
    for r in pii.analyse(docs).collect():
        got.setdefault(r.id, []).append({k: [(s.start, s.end) for s in r[k]] for k in pii.KINDS})
    for i, text in rows_of(docs):
        assert brute.base_spans(text) in got[i]
    assert pii.analyse(empty).collect() == []


def test_pii_of_generated_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op7_pii(spark, sf_dir).collect():
        want = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(brute.spans_text(want)) and r.spans.startswith(brute.spans_text(want))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, want.values()))


def test_pii_terms_and_redaction(spark):
    rows = [(i, f"agent Falke\u00df writes a{i}@b.c about things like rain") for i in range(8)] + [(i, "people write about things like rain and snow") for i in range(10, 90)]
    got = {r.id: r for r in pii.analyse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [rows[0][1][s.start : s.end] for s in got[0].term]
    assert found == ["agent", "Falke\u00df", "writes"] and not got[10].term
    frame = pii.analyse(spark.createDataFrame(rows[:8] + rows[8:], "doc_id long, text string")).where("id = 0")
    assert frame.select(pii.redact(F.col("text"), ("email", F.col("email")), ("term", F.col("term"))).alias("r")).first().r == "[TERM] [TERM] [TERM] [EMAIL] about things like rain"


def test_tiff_codecs():
    r = random.Random(4)
    for data in (b"", b"a", b"aaaabbbbc" * 400, bytes(r.randrange(256) for _ in range(9000)), bytes(r.randrange(3) for _ in range(60000))):
        assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_tiff_pages(spark):
    import struct

    r = np.random.default_rng(2)
    for shape in ((1, 64, 3), (300, 64, 3), (5, 7, 1)):
        pixels = r.integers(0, 256, shape).astype(np.uint8)
        (page,) = tiff.read_pages(tiff.write_page(pixels, rows_per_strip=128))
        assert (page.pixels == pixels).all()
    # two pages, big-endian: PackBits in tiles, LZW in strips
    first, second = r.integers(0, 4, (20, 20, 1)).astype(np.uint8), r.integers(0, 4, (10, 6, 1)).astype(np.uint8)
    tiles = []
    for y in (0, 16):
        for x in (0, 16):
            t = np.zeros((16, 16), np.uint8)
            part = first[y : y + 16, x : x + 16, 0]
            t[: part.shape[0], : part.shape[1]] = part
            tiles.append(tiff.pack_bits(t.tobytes()))
    strips = [tiff.lzw_encode(second[y : y + 4].tobytes()) for y in (0, 4, 8)]
    out = io.BytesIO(b"MM\0*\0\0\0\0".ljust(8, b"\0"))
    out.seek(0, 2)

    def put(parts):
        at = []
        for p in parts:
            at.append(out.tell())
            out.write(p)
        return at

    def directory(tags):
        start = out.tell()
        free = start + 2 + 12 * len(tags) + 4
        entries, extra = b"", b""
        for tag, values in tags:
            packed = struct.pack(f">{len(values)}I", *values)
            inline = packed if len(packed) == 4 else struct.pack(">I", free + len(extra))
            extra += b"" if len(packed) == 4 else packed
            entries += struct.pack(">HHI", tag, 4, len(values)) + inline
        out.write(struct.pack(">H", len(tags)) + entries)
        link = out.tell()
        out.write(b"\0\0\0\0" + extra)
        return start, link

    at = put(tiles)
    one, link = directory([(256, [20]), (257, [20]), (258, [8]), (259, [32773]), (322, [16]), (323, [16]), (324, at), (325, [len(t) for t in tiles])])
    at = put(strips)
    two, _ = directory([(256, [6]), (257, [10]), (258, [8]), (259, [5]), (273, at), (278, [4]), (279, [len(s) for s in strips])])
    data = bytearray(out.getvalue())
    data[4:8], data[link : link + 4] = struct.pack(">I", one), struct.pack(">I", two)
    frame = spark.createDataFrame([(1, bytes(data)), (2, None), (3, b"no"), (4, bytes(data[:40])), (5, b"")], "id long, media binary")
    got = {(r.id, r.page): r for r in tiff.decode_pages(frame.withColumn("page", F.lit("clash"))).collect()}
    assert set(got) == {(1, 0), (1, 1), (3, -1), (4, -1), (5, -1)} and got[3, -1].error
    assert bytes(got[1, 0].pixels) == first.tobytes() and bytes(got[1, 1].pixels) == second.tobytes()


def test_texts_as_images(docs):

    got = tiff.decode_pages(tiff.pack_texts(docs)).collect()
    by_id = {r.id: r for r in got}
    assert len(got) == docs.count()
    for i, text in rows_of(docs):
        raw = (text or "").encode()
        want = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert by_id[i].n_bytes == len(raw) and bytes(by_id[i].pixels) == want and len(by_id[i].feature) == 16


def test_media_query_by_brute_force(spark, sf_dir):
    """Each digest, checksum and feature of op8 from the text alone; stored bytes by the writer, cells by plain means."""
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op8_media(spark, sf_dir).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        media = tiff.write_page(tiff.text_pixels(raw))
        grey = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).sum(axis=2, dtype=np.int64)
        cut = lambda n, k: (n * k // 8, max(n * (k + 1) // 8, n * k // 8 + 1))
        cells = [grey[slice(*cut(len(grey), y)), slice(*cut(64, x))].mean() for y in range(8) for x in range(8)]
        bits = "".join("1" if c > np.median(cells) else "0" for c in cells)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{int(bits, 2):016x}")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want


def test_languages_by_brute_force(spark):
    """Posteriors from counts of n-grams one by one, with the classes' prior; ties go to the language that sorts first."""
    import math
    from collections import Counter

    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("Das Haus, das alte", "de"), ("le chat et la maison", "fr"), ("a dog ran", "en"), ("", "en"), (None, "de"), ("123", "fr"), ("der Hund", "de"), ("the end", None)] * 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fit = lang_id.train(frame, "doc_id", "text", "lang")

    def grams(text):
        plain = lang_id._plain(text)
        return [int(lang_id._buckets(np.array([ord(c) for c in plain[i : i + k]], np.uint32), k)[0]) for k in (1, 2, 3) for i in range(len(plain) - k + 1)]

    labels = Counter(lang for _, _, lang in rows if lang)
    counts = {x: Counter(g for _, t, lang in rows if lang == x for g in grams(t)) for x in sorted(labels)}
    assert fit.langs == sorted(labels)
    for text in ("the haus", "la cat", "ran", "Hund et dog", "x", "the " * 300_000):
        logs = {x: math.log(labels[x] / labels.total()) + sum(math.log((c[g] + 0.5) / (c.total() + 0.5 * (1 << lang_id.BITS))) for g in grams(text)) for x, c in counts.items()} if len(text) < 1000 else None
        told = spark.createDataFrame([(text,)], "text string").select(lang_id.predictor(fit, spark)("text").alias("p")).first().p
        if logs:
            top = max(logs.values())
            best = min(x for x in logs if logs[x] == top)
            assert told.lang == best and abs(told.score - 1 / sum(math.exp(v - top) for v in logs.values())) < 1e-3
        else:
            assert told.lang == "en" and told.score > 0.999


def test_terms_by_brute_force(spark, sf_dir):
    """Term spans of op7: each term by its information over all documents, in documents that hold the entity."""
    import math

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    email = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    words = {i: [w for w in re.findall(r"[^\W\d_]+", re.sub(email, " ", t).lower()) if len(w) >= 3] for i, t in docs.items()}
    base = {i: brute.base_spans(t) for i, t in docs.items()}
    total, risky = len(docs), {k: set() for k in pii.KINDS}
    held = {k: [i for i in docs if base[i][k]] for k in pii.KINDS}
    df = {}
    for ws in words.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    for k, ids in held.items():
        joint = {}
        for i in ids:
            for w in set(words[i]):
                joint[w] = joint.get(w, 0) + 1
        if 0 < len(ids) < total:
            risky[k] = {w for w, n in joint.items() if n >= 5 and n * total >= (len(ids) / total) ** -0.8 * df[w] * len(ids) * (1 - 1e-12)}
    for r in queries.op7_pii(spark, sf_dir).collect():
        mine = set().union(*(risky[k] for k in pii.KINDS if base[r.doc_id][k]))
        every = [s for spans in base[r.doc_id].values() for s in spans]
        found = [m.span() for m in re.finditer(r"[^\W\d_]+", docs[r.doc_id]) if m[0].lower() in mine]
        want = [s for s in found if not any(a < s[1] and s[0] < b for a, b in every)]
        assert [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term:")] == want and math.isfinite(total)


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_contamination(spark, docs, empty, monkeypatch, index_bytes):
    monkeypatch.setattr(decontam, "INDEX_TEXT_BYTES", index_bytes)
    items = [(1, "a b c d e f g h"), (2, None), (3, ""), (None, "one"), (10, "one two"), (4, "WORT " * 12), (5, "\u00c4\u00d6 \u4f60\u597d"), (4, "tab here"), (6, "d e f g h i j k l m n")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontam.contamination(docs, benchmark).collect():
        got.setdefault(r.id, []).append((r.n_words, sum(e - s for s, e in r.hits), len(r["items"]), decontam.digest(r["items"]), bool(r.hits)))
    for i, text in rows_of(docs):
        assert brute.contamination(text, items) in got[i]
    assert decontam.contamination(empty, benchmark).collect() == []
    assert all(not r.hits for r in decontam.contamination(docs, benchmark.limit(0)).collect())


@pytest.mark.parametrize("prefixes", [2_000_000, 10])
def test_contamination_by_joins(spark, sf_dir, monkeypatch, prefixes):
    monkeypatch.setattr(decontam, "PREFIXES", prefixes)
    want = {r.doc_id: r for r in queries.op9_decontamination(spark, sf_dir).collect()}
    monkeypatch.setattr(decontam, "INDEX_TEXT_BYTES", 0)
    assert {r.doc_id: r for r in queries.op9_decontamination(spark, sf_dir).collect()} == want


def test_contamination_of_repeated_rows_by_joins(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    passage, other = " ".join(words[:20]), " ".join(words[30:45])
    items = spark.createDataFrame([(str(i), " ".join(words[i : i + 12])) for i in range(0, 48, 6)], "item_id string, text string")
    rows = [(1, passage), (1, passage), (1, other), (None, other), (None, passage), (None, "clean text"), (None, None), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def results():
        return sorted((str(r.id), r.n_words, str(r.hits), str(r["items"])) for r in decontam.contamination(docs, items).collect())

    want = results()
    assert len(want) == len(rows) and sum(x[2] != "[]" for x in want) == 5
    monkeypatch.setattr(decontam, "INDEX_TEXT_BYTES", 100)
    assert results() == want


def test_contamination_index_is_small():
    """2 MB of words in a benchmark: bytes of the index for each word."""
    import pickle

    r = np.random.default_rng(5)
    items = [(str(i), r.integers(0, 2**63, 1000).astype(np.uint64)) for i in range(300)] + [("x", r.integers(0, 2**63, 3).astype(np.uint64)), ("none", np.zeros(0, np.uint64))]
    index = decontam.Index(items)
    index.post(np.zeros(len(index.vocabulary), np.int64))
    assert len(pickle.dumps(index)) < 50 * 300_003 and len(index.starts) == 300 * 991 + 1


def test_html():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><a href='/'>Home</a> Site</header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies to make this site better for you and for everybody else.</div><article><h1>Title &amp; more</h1><p>First&nbsp;line<br>second   <b>bold</b>.</p>"
        "<script>var x = '</p><p>no</p>';</script><!-- <p>no</p> --><p>It.</p><p>See <a href=x>this</a> too.</p></article><aside>Other <a href=3>news</a></aside>"
        "<div id=comments><p>Great article, thank you so much for writing all of this down for us!</p></div><form><label>Mail</label><input></form><footer>&copy; all</footer></body></html>"
    )
    assert html_text.main_text(page) == "Title & more First line second bold . It. See this too.".replace("bold .", "bold.")
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav><a href=1>x</a></nav>") == ""
    assert html_text.main_text("<article><p>open <b>and <script>never closed") == "open and"
    plain = "<body><div><a href=1>Home</a></div><div>" + "word " * 60 + "</div><div>" + "more " * 50 + "</div></body>"
    assert html_text.main_text(plain) == ("word " * 60 + "more " * 50).strip()


def test_html_of_generated_pages(spark, sf_dir):
    import html
    import re

    for r in html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|h1|br)", m[0]) else "", body)).split())
        assert r.text == want and r.n_chars == len(want)


WORDS, MORE = " ".join(["word"] * 30), " ".join(["text"] * 50)


@pytest.mark.parametrize("around", [
    "<form id='aspnetForm'><article>{}</article></form>", "<div class='page no-sidebar'><article>{}</article></div>", "<div class='has-banner'>{}</div>", "<div id='page-with-menu'>{}</div>",
    "<section aria-label='search results'>{}</section>", "<article><div class='entry-header'>{}</div></article>", "<form><div>{}</div></form>", "<div class='content has-sidebar'>{}</div>",
    "<div id='main' class='with-comments'>{}</div>", "<div class='banner-wrapper'><main>{}</main></div>", "<noscript><div>{}</div>", "<object><article>{}</article>", "<div class=ads-page>{}</div>",
])
def test_html_wrappers(around):
    page = f"<html><body><nav><a href=1>Home</a><li><a href=2>About us</a></nav>{around}<footer>All rights reserved by us</footer></body></html>"
    assert html_text.main_text(page.format(f"<h1>My title</h1><p>{WORDS}</p><p>Short one.</p><p>{MORE}</p>")) == f"My title {WORDS} Short one. {MORE}"


def test_html_places_do_not_decide_alone():
    links = "".join(f"<li><a href={i}>{x}</a>" for i, x in enumerate(("Home", "About", "Contact us")))
    assert html_text.main_text(f"<main><ul>{links}</ul><h1>Title</h1><p>{WORDS}</p></main>") == f"Title {WORDS}"
    assert html_text.main_text(f"<article><p>{WORDS}</p></article><div class=ad>{MORE}</div>") == WORDS
    assert html_text.main_text(f"<article><p>{WORDS}</p><ol class=commentlist><li><article>{MORE}</article></ol></article>") == WORDS
    assert html_text.main_text(f"<aside><article>{MORE}</article></aside><article>{WORDS}</article>") == WORDS
    table = html_text.labelled()
    places = {p: {r[-1] for r in table if r[6] == p} for p in html_text.PLACES}
    assert all(places[p] == {0, 1} for p in (html_text.ARTICLE, html_text.MAIN, html_text.NONE, html_text.HINT))


def test_html_tree_by_brute_force():
    """The tree against one that tries every cut of every feature anew."""

    def impurity(rows):
        return sum(r[-1] for r in rows) * sum(1 - r[-1] for r in rows) * 2 / len(rows)

    def decide(values, rows, depth=10):
        ones = sum(r[-1] for r in rows)
        cuts = [(k, (x + y) / 2) for k in range(len(values)) for x, y in zip(*(sorted({r[k] for r in rows})[i:] for i in (0, 1)))] if depth and 0 < ones < len(rows) else []
        if not cuts:
            return int(2 * ones >= len(rows))
        best = None
        for k, cut in cuts:
            cost = impurity([r for r in rows if r[k] <= cut]) + impurity([r for r in rows if r[k] > cut])
            if best is None or cost < best[0] - 1e-9:
                best = cost, k, cut
        _, k, cut = best
        return decide(values, [r for r in rows if (r[k] <= cut) == (values[k] <= cut)], depth - 1)

    r = random.Random(8)
    table = html_text.labelled()
    assert all(html_text.classify(x[:-1], html_text.tree()) == x[-1] for x in table)
    for _ in range(12):
        shape = [(r.choice((1, 3, 8, 20, 60)), r.choice((0.0, 0.2, 1.0)), r.choice(html_text.PLACES)) for _ in range(r.randrange(1, 6))]
        for i, f in enumerate(html_text.features(shape)):
            same = sum(n for n, _, p in shape if p == shape[i][2])
            total = sum(n for n, _, _ in shape)
            sides = [shape[k][:2] if 0 <= k < len(shape) else (0, 0.0) for k in (i, i - 1, i + 1)]
            assert f == (*sides[0], *sides[1], *sides[2], shape[i][2], same / total, sum(n for n, _, p in shape if p > 0) / total)
            assert html_text.classify(f, html_text.tree()) == decide(f, table)


@pytest.mark.parametrize("text", ["<a ", '<a x="', "</div ", "<svg>", "</script ", "<script>", "<div>", "<div></section>", "<a x='\"><", '<a x="><a x=" y="', "<", "&amp", "<![CDATA[", "<div class=a >", "= \t"])
def test_html_broken_markup_in_linear_time(text):
    import time

    began = time.process_time()
    html_text.main_text(text * (1_000_000 // len(text)))
    assert time.process_time() - began < 5


def test_html_frame(spark):
    frame = spark.createDataFrame([(1, None, "x", 7), (2, "<p>" + "long " * 30_000, "y", 7), (2, "<p>" + "long " * 30_000, "y", 7)], "page_id long, html string, text string, _main int")
    rows = html_text.extract(frame).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 3 and all(r["_main"] == 7 for r in rows)
    assert got[1].text == "" and got[1].n_chars == 0 and got[2].n_chars == 30_000 * 5 - 1
    assert html_text.extract(frame.limit(0)).count() == 0
