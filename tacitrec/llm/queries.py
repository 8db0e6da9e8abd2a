"""One query per corpus operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacitrec.llm.common import documents, lower_ascii, word_count
from tacitrec.llm.compression import compression_bands
from tacitrec.llm.exact_dedup import StreamingDedup
from tacitrec.llm.language import LanguageModel, fit, held_out, identify
from tacitrec.llm.line_dedup import drop_frequent_lines
from tacitrec.llm.merkle import build, prove
from tacitrec.llm.mixing import mix
from tacitrec.llm.packing import PackParams, pack
from tacitrec.llm.ranked import build_index, search
from tacitrec.llm.repeats import remove_repeats
from tacitrec.llm.sharding import assign, balanced_tree, slots, with_one_more
from tacitrec.llm.simhash import near_duplicates
from tacitrec.llm.url_templates import filter_urls, path_of
from tacitrec.llm.warc import archived_pages, new_archive, with_revisits, write_archive
from tacitrec.tables import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARD_TREE = balanced_tree(5, 2, 4)  # 40 shards
URL_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
    ("com/fr/", "allow"), ("com/de/", "block"),
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_exact_dedup(spark, sf_dir):
    dedup = StreamingDedup(spark, f"{sf_dir}/documents.parquet", new_path(spark, "dedup-state"))
    dedup.advance()
    return dedup.verdicts().select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def pack_params() -> PackParams:
    """Sequences of 2,048 tokens of the 50k byte vocabulary; the files lie on every machine."""
    import public_tokenizers as public

    return PackParams(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


@query
def op2_packing(spark, sf_dir):
    pieces = pack(documents(spark, sf_dir), pack_params())
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op3_compression_bands(spark, sf_dir):
    return compression_bands(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(url, good)`: pages show documents by number, and labels cover some documents."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})[^/0-9]*/?$", 1).try_cast("bigint")
    shown = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", number.alias("doc_id"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return shown.join(labels, "doc_id").select("url", good.alias("good"))


@query
def op4_url_templates(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, labelled_urls(spark, sf_dir), URL_RULES)


@query
def op5_suffix_dedup(spark, sf_dir):
    found = remove_repeats(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op6_simhash(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def language_model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    """Learned from the labelled documents that are not held out."""
    return fit(documents(spark, sf_dir).filter(~held_out()))


@query
def op7_language(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out().alias("held_out"))
    return identify(docs, language_model(spark, sf_dir)).drop("text")


@query
def op8_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mix(docs, "doc_id", "source", F.col("words")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


@query
def op9_line_dedup(spark, sf_dir):
    kept = drop_frequent_lines(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


@query
def op10_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows = assign(assign(docs, "doc_id", SHARD_TREE), "doc_id", with_one_more(SHARD_TREE), "grown_shard")
    return slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@query
def op11_merkle(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    shown = F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    proofs = prove(build(documents(spark, sf_dir), LEAF_FIELDS, shown={"text": shown}))
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op12_warc(spark, sf_dir):
    path = new_archive(spark)
    write_archive(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return archived_pages(spark, path)


@query
def op13_ranked_search(spark, sf_dir):
    return search(build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
