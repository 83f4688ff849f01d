"""The operators as queries over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, license_scan, ngram_join, packing, quality, secret_scan, sharding, token_rollup, tokens, warc
from .state import keep, new_folder

CRAWL_DATE = "2024-01-01T00:00:00Z"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def responses_of(pages: DataFrame) -> DataFrame:
    """`pages` as WARC response records."""
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    h = F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("null"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(CRAWL_DATE).alias("date"), F.concat(head, F.coalesce("html", F.lit(""))).cast("binary").alias("content"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.build_derivatives(responses_of(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("record_id", "type", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", F.octet_length("content").cast("long").alias("content_length"), F.crc32("content").alias("content_crc32"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"), carry=["doc_id"])
    c = F.col("contamination")
    longest = F.array_max(F.transform(c["matches"], lambda m: m["words"]))
    return found.select("doc_id", *[c[x].alias(x) for x in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")], F.coalesce(longest, F.lit(0).cast("long")).alias("longest_match"))


def count_tokens(documents: DataFrame, word_path: str, byte_path: str) -> DataFrame:
    """doc_id, source, lang, text_key (two hashes: 128 bits tell texts apart at any size) and the counts of two tokenizers, word_bpe and byte_bpe."""
    names = ["doc_id", "source", "lang", "key_1", "key_2", "word_bpe", "byte_bpe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words, raw = tokens.word_tokenizer(word_path), tokens.byte_counter(byte_path, public_tokenizers.PATTERN)
        for batch in batches:
            for at, to, _, first in words.chunks(batch.column(5)):
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(first[1:] - first[:-1]), pa.array(raw.count(part.column(5)))], names=names)

    docs = documents.select("doc_id", "source", "lang", F.xxhash64("text").alias("key_1"), F.xxhash64(F.lit(7), "text").alias("key_2"), F.col("text"))
    counted = docs.mapInArrow(run, "doc_id long, source string, lang string, key_1 long, key_2 long, word_bpe long, byte_bpe long")
    return counted.select("doc_id", "source", "lang", F.struct("key_1", "key_2").alias("text_key"), "word_bpe", "byte_bpe")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, exact copies deleted, the rest revised to another tokenizer, and the deletes sent again."""
    counted = keep(count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.tiktoken")), "counts")
    least = keep(counted.groupBy("text_key").agg(F.min("doc_id").alias("least")), "least")
    # sums and join are written, each alone: in a stage without sums, a hot text's rows can be split
    joined = counted.join(least, "text_key")  # keys are never null
    counted = keep(joined.select("source", "lang", "word_bpe", "byte_bpe", (F.col("doc_id") > F.col("least")).alias("copy")), "copies")

    def changes(df: DataFrame, op: str, new: str, old: str | None = None) -> DataFrame:
        return df.select(
            F.lit(op).alias("op"),
            "source",
            "lang",
            F.lit(new).alias("tokenizer_version"),
            F.col(new).alias("n_tokens"),
            F.lit(old).cast("string").alias("old_tokenizer_version"),
            (F.col(old) if old else F.lit(None).cast("long")).alias("old_n_tokens"),
        )

    rollup = token_rollup.TokenRollup(spark, new_folder(spark, "rollup"))
    rollup.apply("1-load", changes(counted, "insert", "word_bpe"))
    deletes = changes(counted.where("copy"), "delete", "word_bpe")
    rollup.apply("2-copies", deletes)
    rollup.compact()
    rollup.apply("3-revise", changes(counted.where("NOT coalesce(copy, false)"), "revise", "byte_bpe", "word_bpe"))
    rollup.apply("2-copies", deletes)
    return rollup.totals()


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "lost_chars")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("secrets.base")
    count = lambda k: F.size(F.filter(base, lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.joined_text(base), 256).alias("base_sha256"), secret_scan.joined_text(F.col("secrets.all")).alias("spans"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.col("license.sentence_ids")
    return found.select("doc_id", F.size(ids).cast("long").alias("n_sentences"), F.array_join(ids, ",").alias("sentence_ids"), F.col("license.rule").alias("rule"), F.col("license.name").alias("license"), F.col("license.kind").alias("kind"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_warc_derivatives, op2_decontamination, op3_token_counts, op4_packing, op5_html_extraction, op6_ngram_jaccard, op7_quality_rules, op8_secret_scan, op9_license_scan, op10_sharding)}
