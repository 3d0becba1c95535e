"""The training-data pipeline: five stages, each written as Parquet and read as the next one's input.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept. All but the last return the
columns of ``documents``. Null and empty texts, ties, repeated rows, empty tables and further columns are handled as the
operators' docstrings say; the stages add what is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.llm import byte_bpe, lines, mixing, near_dedup, quality
from kinfold.session import cut

SIMILAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence rules reject go, null and empty texts among them."""
    judged = cut(quality.divergence_rules(docs).select("row", "kept"))  # else the filter repeats the rules' whole expression
    return judged.where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, ``n_chars`` follows; a document that lost lines and has no word left goes too."""
    done = lines.dedupe_lines(docs, search="segments", equal_least=1)
    done = done.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Null ids all stay.

    Rows that share an id but not text, source and language are documents of their own; of those that share all four, one stays.
    """
    keyed = docs.where(F.col("doc_id").isNotNull()).withColumn("_key", F.xxhash64("doc_id", "text", "source", "lang"))
    found = near_dedup.near_duplicates(keyed, "_key", percent=SIMILAR_PERCENT).select("_key", "component_id")
    named = found.join(keyed.select("_key", "doc_id"), "_key")  # columns without the text
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first")).select("first._key")
    one = keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows with one id and text share their copies."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    copies = mixing.mix(keyed, key="_key").groupBy("_key").agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    taken = keyed.dropDuplicates(["_key"]).join(copies, "_key")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, n_tokens, n_bytes, same_text, ids)``: the ids and whether they decode to the text's bytes."""
    coded = byte_bpe.encode(docs.select("doc_id", "source", "text")).withColumn("raw", byte_bpe.decode("ids"))
    return coded.select(
        "doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.octet_length("raw").cast("long").alias("n_bytes"),
        (F.col("raw") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("same_text"), "ids")


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup_documents),
    ("mix_sources", mix_sources), ("byte_bpe", encode_bytes),
]

#: SimHash, HyperMinHash and the tokenizer have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
