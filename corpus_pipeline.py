"""From raw documents to packed sequences: each stage works on all that the one before it kept.

All columns of documents stay, extra ones and such with clashing names too, until packing. Null texts count as empty ones:
the rules reject what has too few words. Rows without doc_id are judged by their text, never anybody's duplicate, and keep
their passages. Repeated rows are judged alike; of equal documents the smallest id stays, and rows that share this id and
a text stay together. Texts of any length are taken whole. An empty table passes every stage as an empty table, and
packing gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import best_fit_packing, jaccard_join, quality_rules, suffix_dedup, weak_quality
from lodestone.llm.queries import TOKENIZER, table
from lodestone.llm.shared import staged


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the rules reject go. Ties of the model's score with its threshold are kept."""
    return quality_rules.keep_good(docs, quality_rules.fitted(docs, table(spark, sf_dir, "labels")))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier rejects go. Where nothing is voted bad, all stay."""
    return weak_quality.keep_good(docs, weak_quality.fitted(docs)[1])


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class of near duplicates the document of the smallest id stays, and every row without an id."""
    return jaccard_join.keep_one(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: repeated passages are cut out, but for their first occurrence. Documents of which nothing is left go."""
    return suffix_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: what is left, in sequences of at most 2048 tokens."""
    return best_fit_packing.packed(docs, TOKENIZER, end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("n-gram Jaccard join", jaccard_join_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: No stage but the first one's counts can be written in SQL (trees, EM, hashing, tokenizers), so tests/llm compares
#: each stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{k}-{name.replace(' ', '-')}")
    return docs
