"""A training-corpus pipeline over ``documents``: each stage applies one operator to all its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``. ``run`` writes
each stage's result as Parquet to the shared folder and rereads it for the next.

Decisions: toxic documents (score of 0.7 or more) go; of equal texts the row with the smallest id stays; of documents connected by
similarity the row with the smallest id stays; documents with a benchmark window go; the rest is packed. Every row is judged by its own text, so
rows with null or repeated ids are treated like any other; a null id counts as larger than all ids. The operators carry the other columns of a row along,
so no stage joins its decisions back by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm.common import materialise, table
from wharfline.llm.decontaminate import decontaminate
from wharfline.llm.exact_dedup import exact_dedup
from wharfline.llm.ngram_join import ngram_join
from wharfline.llm.packing import pack_sequences
from wharfline.llm.toxicity import toxicity

CARRY = ["lang", "source", "n_chars"]


def rows(judged: DataFrame) -> DataFrame:
    """The columns of documents of rows that were carried through an operator."""
    return judged.select("doc_id", "text", *[f"carried.{c}" for c in CARRY])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rows(toxicity(docs, table(spark, sf_dir, "labels"), carry=CARRY).filter("score < 0.7"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal means equal after no change, a null text being empty; the row that stays keeps its null."""
    found = exact_dedup(docs.withColumn("was_null", F.col("text").isNull()), carry=[*CARRY, "was_null"]).filter("kept")
    return rows(found.withColumn("text", F.when(~F.col("carried.was_null"), F.col("text"))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rows(ngram_join(docs, carry=CARRY).filter("kept"))


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rows(decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=CARRY).filter(F.size("spans") == 0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("benchmark_decontamination", leaked), ("packing", packed)]

#: SQL cannot express the toxicity model or the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
