"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import ann, common, line_dedup, media, near_dup, packing, pii, quality, sharding, span_dedup, word_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(common.documents(spark, sf_dir), BYTE_TOKENIZER, capacity=2048, separator=0)


@query
def op10_ring_sharding(spark, sf_dir):
    placed = sharding.sharded_documents(common.documents(spark, sf_dir), shards=16, vnodes=128, slack=0.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_pair_index_bpe(spark, sf_dir):
    return word_bpe.digests(common.documents(spark, sf_dir), WORD_TOKENIZER)


@query
def op9_near_duplicates(spark, sf_dir):
    """Word 3-shingles at 0.85; a pair at the threshold is missed with probability (1 - 0.85**5)**32 < 1e-8."""
    return near_dup.classes(common.documents(spark, sf_dir), k=3, percent=85, bands=32, rows=5)


@query
def op3_gif_media(spark, sf_dir):
    return media.digests(common.documents(spark, sf_dir))


@query
def op4_line_dedup(spark, sf_dir):
    kept = line_dedup.without_repeats(common.documents(spark, sf_dir).select("doc_id", "text"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = line_dedup.ORACLE


@query
def op8_quality_nbsvm(spark, sf_dir):
    """Fitted on at most 8,000 labelled rows outside the held-out quarter."""
    labels = common.table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    scored = quality.scored(common.documents(spark, sf_dir).select("doc_id", "text"), labels, sample=8000)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op6_pii_pseudonyms(spark, sf_dir):
    docs = pii.pseudonymised(common.documents(spark, sf_dir).select("doc_id", "text"), pii.key_of(spark))
    return docs.select("doc_id", "text", F.size("pii").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("pii.kind")), ",").alias("kinds"))


@query
def op7_ivf_pq_neighbours(spark, sf_dir):
    vectors = common.table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op5_span_dedup(spark, sf_dir):
    return span_dedup.without_repeats(common.documents(spark, sf_dir), window=100, with_text=False)
