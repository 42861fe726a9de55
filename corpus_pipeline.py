"""The corpus pipeline: documents of low quality, copies, near copies and contaminated documents go; the rest is tokenised.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns the columns of documents; the last returns token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborlens.llm.bpe import bpe_digests
from harborlens.llm.common import stored, table
from harborlens.llm.decontaminate import drop_contaminated
from harborlens.llm.exact_dedup import drop_copies
from harborlens.llm.quality import drop_low_quality
from harborlens.llm.queries import tokenizer_file
from harborlens.llm.simhash import drop_near_copies


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good: well formed and civil."""
    return drop_low_quality(docs, labels=table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_copies(docs)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the smallest id."""
    return drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the text that they decode to."""
    return bpe_digests(docs, tokenizer_file())


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_duplicates),
    ("simhash_dedup", near_duplicate_groups),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]
#: SimHash groups, the classifier and BPE are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after another; each but the last is written to the shared folder, so that it runs once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
