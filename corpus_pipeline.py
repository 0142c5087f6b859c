"""A training corpus from raw documents: quality filter, line dedup, near-duplicate removal,
pseudonyms, packing.

Each stage works on all that its predecessor kept; all but the last return the columns of documents
(with n_chars brought in line with the text). A null text counts as empty throughout, and very long texts
are worked on whole; rows without a doc_id are filtered and cleaned like others but take no part in
links; of rows equal in doc_id and text one stays, of a class of near copies that of the least doc_id; an
empty table gives an empty one at each stage; further columns, whatever their names, come back as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm import catalog, common, line_dedup, near_dup, packing, pii, quality


def _held(docs: DataFrame) -> DataFrame:
    """doc_id and text, with all columns but the text in `row`, where no operator replaces them."""
    return docs.select("doc_id", "text", common.whole(docs.drop("text")).alias("row"))


def _columns(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with the text that was made; n_chars, where there is one, follows the text."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return common.unpacked(made, docs.columns, new)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1."""
    labels = common.table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    scored = quality.scored(_held(docs), labels, sample=8000)
    return common.unpacked(scored.where("predicted = 1"), docs.columns, {"text": F.col("text")})


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay only in the last of them."""
    return _columns(line_dedup.without_repeats(_held(docs), min_chars=20, min_docs=3), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicate texts: five-word shingles, similarity 0.8."""
    kept = near_dup.survivors(docs, k=5, percent=80, bands=32, rows=4)
    own = docs.where("doc_id is not null").select(common.whole(docs).alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_hash"))
    place = F.row_number().over(Window.partitionBy("own", "own_hash").orderBy("row.text"))
    found = own.join(kept, (F.col("own") == F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))).withColumn("place", place)
    return common.unpacked(found.where("whole or place = 1"), docs.columns, {}).unionByName(docs.where("doc_id is null"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format."""
    return _columns(pii.pseudonymised(_held(docs), pii.key_of(spark)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go among sequences of 2048."""
    return packing.pack(docs, catalog.BYTE_TOKENIZER, capacity=2048, separator=0)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", repeated_lines),
    ("near-duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("packing", packed),
]

#: Sketches, fitted weights and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each keeps is written as Parquet and read by the next."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs)
    return docs
