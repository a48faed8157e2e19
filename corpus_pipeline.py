"""A training-data pipeline over `documents`: quality rules, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of documents. doc_id names a document;
equal doc_ids are treated as one document where their texts are equal, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, stored
from tidemark.llm.jaccard import jaccard_classes
from tidemark.llm.mixing import WEIGHTS, mix
from tidemark.llm.packing import pack_documents
from tidemark.llm.repetition import quality
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
END_ID = 2
#: Shortest passage that goes: 51 words of every language at hand take more (248 bytes at least in the test tables, 300 to 350 mostly).
PASSAGE_BYTES = 240


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, similarity 0.8): the one of the smallest doc_id."""
    classes = stored(jaccard_classes(docs, size=5, percent=80), "pipeline-classes")
    # Only ids that go or come more than once are looked up: they are far fewer than those that stay.
    is_first = F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), 1).otherwise(0)
    other = stored(classes.groupBy(F.col("doc_id").alias("id")).agg(F.sum(is_first).alias("firsts")).where("firsts != 1"), "pipeline-others")
    # One plan at every size: texts are dealt by doc_id once, and both parts of the result read that shuffle.
    marked = docs.select(*COLUMNS).join(other.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    again = marked.where("firsts > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return marked.where("firsts IS NULL").select(*COLUMNS).unionByName(again)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of PASSAGE_BYTES and more that start in more than one place."""
    cut = remove_repeats(docs.select(*COLUMNS), length=PASSAGE_BYTES, with_text=True)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mix(docs, WEIGHTS, carry=["text", "lang", "n_chars"])
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full windows of 512 to 4096 tokens."""
    return pack_documents(docs, tokenizer_path(), END_ID)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("source mix", source_mix), ("packing", packing)]
#: The near-duplicate, suffix-array and tokenizer stages are not SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
