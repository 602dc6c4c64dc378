"""The corpus pipeline: five operators, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import common, decontam, neardup, packing, pii, quality
from tidewake.llm.queries import surrogate_key, table, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; the trees learn from labelled documents that are not held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = common.fresh(docs, "score")
    return quality.score(docs, model, name=score).filter(F.col(score) >= 0.3).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the smallest doc_id.

    Of rows that share that doc_id one stays, that with the smallest text (then the smallest hash of
    the other columns); rows without doc_id all stay.
    """
    found = neardup.near_duplicates(docs)
    kept = found.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    first = F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*plain))).alias("first")
    named = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("first.*")
    return named.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with entities replaced by surrogates; n_chars follows the new text where it is a column."""
    (count,) = common.fresh(docs, "n_entities")
    out = pii.pseudonymize(docs, surrogate_key(spark), count).drop(count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: SQL has neither trees nor tokenizers nor keyed surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again.

    What a stage wrote for itself is deleted once its result is written, and a result once the next
    one is.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with common.Scope() as scope:
            docs = scope.keep(common.materialize(stage(spark, docs, sf_dir), name))
        if k:
            common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
