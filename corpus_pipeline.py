"""A corpus pipeline of five stages over the documents table; each calls one operator of tablekit.llm.

Every stage takes all rows that the one before kept and returns the columns of documents; the last returns the packed
pieces. Rows with null or repeated values, empty tables and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.llm import linededup, minhash, packing, quality, toxicity
from tablekit.llm.common import written


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be toxic.

    Null and empty texts stay; a null or repeated doc_id does not matter, each row is judged by its own text; an empty
    table, or one without labels, loses nothing; all columns stay, also such as differ only by case.
    """
    return toxicity.keep_civil(docs, toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the quality rules; null and empty texts do. A null or repeated doc_id does not matter; an
    empty table stays empty; all columns stay, also such as differ only by case."""
    return quality.keep_quality(docs)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that ten or more documents hold out of all texts; n_chars follows the text, other columns stay.

    A null text becomes the empty one; what is left of ten exact copies is empty, and stays; rows of one doc_id, or of
    none, count as documents of their own; an empty table stays empty.
    """
    out = linededup.dedup_lines(spark, docs)
    if "n_chars" in docs.columns:
        dropped = F.col(f"_c{len(docs.columns) + 1}") > 0
        text, chars = (f"_c{docs.columns.index(c)}" for c in ("text", "n_chars"))
        plain = out.toDF(*[f"_c{i}" for i in range(len(out.columns))])
        plain = plain.withColumn(chars, F.when(dropped, F.char_length(text)).otherwise(F.col(chars)).cast(docs.schema["n_chars"].dataType))
        out = plain
    return out.select(*out.columns[: len(docs.columns)]).toDF(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8.

    Documents without words are nobody's copies; rows without a doc_id all stay, of rows that share one the smallest text;
    an empty table stays empty; all columns stay.
    """
    return minhash.keep_one(spark, docs, size=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left into sequences of 1024 ids; a null or empty text is the end id alone, an empty table gives
    no pieces. The result has the pieces' columns, not those of documents."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", civil), ("quality_rules", good), ("line_dedup", without_common_lines), ("minhash_near_dedup", one_of_each), ("best_fit_packing", packed)]
#: Toxicity scores and the sequence numbers of packing cannot be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
