"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, decontam, html_text, lang_id, line_dedup, near_dup, pieces, pii, tiff, warc

#: Where the public tokenizers lie: the default of a parameter.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    model = pieces.load_model(model_path)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.decode_documents(pieces.encode_documents(docs, model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        F.length("decoded").cast("long").alias("decoded_chars"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = lang_id.identify(docs)
    return found.select("doc_id", lang_id.held_out("doc_id").alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    done = chat.format_conversations(chat.canonical(rows.unionByName(probe)))
    turns = chat.parse_turns(F.col("formatted"))
    said = F.transform("loss_mask", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    done = done.select("conv_id", "formatted", turns.alias("turns"), F.array_join(F.transform(said, chat.unescape), "").alias("loss"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _sha256(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        _sha256(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), **line_dedup.WHOLE)
    return done.select("doc_id", "lines_dropped", F.length("text").cast("long").alias("kept_chars"), _sha256(F.col("text")).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    found = warc.read_records(index)
    # the digest is that of the payload as it was read; a revisit's is that of the payload it refers to
    read = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return found.select(F.col("id").alias("page_id"), size.alias("payload_bytes"), read.alias("payload_digest"), "record_type", "refers_to")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.analyse(_table(spark, sf_dir, "documents"))
    base = [pii.join_spans(k, F.col(k)) for k in pii.KINDS]
    return found.select(
        F.col("id").alias("doc_id"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        _sha256(pii.joined(*base)).alias("base_sha256"),
        pii.joined(*base, pii.join_spans("term", F.col("term"))).alias("spans"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.pack_texts(_table(spark, sf_dir, "documents"))
    pages = tiff.decode_pages(stored)
    return pages.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        _sha256(F.array_join("items", ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_minhash_near_dedup, op2_sentencepiece, op3_language_id, op4_chat_format, op5_line_dedup, op6_warc, op7_pii, op8_media, op9_decontamination, op10_html_text)
    return {f.__name__: f for f in all_}
