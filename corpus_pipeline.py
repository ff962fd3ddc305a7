"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as
the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import decontaminate, lines, neardup, packing, quality
from folioforge.llm.staging import discard, fresh_path
from folioforge.sources.files import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their faulty lines; those that fail the rules go, null and empty texts among them.

    Rows are judged one by one, so repeated rows and ids and null ids change nothing; an empty table stays empty.
    """
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated line windows; those that lose their whole text go.

    The first in the order of doc_id (null first) and text keeps its lines; rows that repeat both are one
    document.  Null and empty texts stay as they are; an empty table stays empty.
    """
    return lines.strip_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.80 or more on five-word shingles, the one of the least doc_id.

    Rows go by their own text: others of their doc_id do not matter, and rows that repeat doc_id and text
    stay or go together.  Rows of null doc_id and those without words stay; an empty table stays empty.
    """
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in windows of the benchmark.

    Rows go by their own text, be their doc_id null or repeated; null and empty texts stay; an empty
    benchmark drops nothing; an empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the packed sequences; a null text is a piece of one id.

    Repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: SQL can express neither the tokenizer nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each but the last goes through a table in the shared folder.

    A table is deleted as soon as the next one is written, but for the last, which the result may read again.
    """
    docs, before = table(spark, f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
