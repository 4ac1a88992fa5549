"""The index as tables: documents, chunks, term weights and vectors, built from raw documents and kept up to date."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..streaming.ingest import normalized
from . import chunking, statistics, vectors
from .incremental import deleted, replaced


@dataclass
class Index:
    documents: DataFrame
    chunks: DataFrame
    terms: DataFrame
    embeddings: DataFrame

    def write(self, folder: str) -> None:
        for name in ("documents", "chunks", "terms", "embeddings"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def read_index(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in ("documents", "chunks", "terms", "embeddings")))


def build(raw: DataFrame, sizes: chunking.Sizes | None = None, dim: int = vectors.DIM) -> Index:
    """raw: source_system, external_id, uri, title, text, and if there are any kind and language."""
    extra = [c for c in ("kind", "language") if c in raw.columns]
    facts = raw.select(T.stable_id(F.col("source_system"), F.col("external_id")).alias("doc_id"), *extra).dropDuplicates(["doc_id"])
    docs = normalized(raw).dropDuplicates(["doc_id"]).join(facts, "doc_id")
    for c in ("kind", "language"):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit("prose" if c == "kind" else ""))
    chunks = chunking.chunked(docs, sizes)
    terms = statistics.embedder_idf(docs)
    # how many documents the weights were fitted to is part of the space's name: a refit is another space
    mark = vectors.fingerprint(dim, vectors.GRAM, docs.count())
    return Index(docs, chunks, terms, _embedded(chunks, terms, dim, mark))


def _embedded(chunks: DataFrame, terms: DataFrame, dim: int, fingerprint: str) -> DataFrame:
    return vectors.embed(chunks.select("chunk_id", F.col("indexed_text").alias("text")), terms, "chunk_id", dim=dim).withColumn("fingerprint", F.lit(fingerprint))


def missing_vectors(chunks: DataFrame, embeddings: DataFrame, fingerprint: str) -> DataFrame:
    """Chunks without a vector of the current space."""
    return chunks.join(embeddings.where(F.col("fingerprint") == fingerprint).select("chunk_id"), "chunk_id", "left_anti")


def embed_missing(index: Index, fingerprint: str, dim: int = vectors.DIM) -> DataFrame:
    """The embeddings with new ones for chunks that had none of this space."""
    return replaced(index.embeddings, _embedded(missing_vectors(index.chunks, index.embeddings, fingerprint), index.terms, dim, fingerprint), "chunk_id")


def without_documents(index: Index, gone: DataFrame) -> Index:
    """The index without some documents (doc_id), their chunks and vectors; term weights stay until the next refit."""
    docs, chunks = deleted("doc_id", gone, index.documents, index.chunks)
    return Index(docs, chunks, index.terms, index.embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_semi"))


def append_journal(spark: SparkSession, path: str, cycle: int, phase: str, payload: dict) -> None:
    spark.createDataFrame([(cycle, phase, json.dumps(payload, sort_keys=True))], "cycle int, phase string, payload string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def newest(rows: DataFrame, order: list[str], most: int | None = None) -> DataFrame:
    """rows with the latest first; of many, each partition keeps no more than `most`."""
    rows = rows.orderBy(*[F.desc(c) for c in order])
    return rows if most is None else rows.limit(most)


def read_journal(spark: SparkSession, path: str, limit: int | None = None, cycle: int | None = None) -> DataFrame:
    """The newest entries first, or one cycle's in order."""
    rows = spark.read.parquet(path)
    if cycle is not None:
        return rows.where(F.col("cycle") == cycle).orderBy("at")
    return newest(rows, ["at"], limit)


def stale_cursor(cursor: DataFrame, documents: DataFrame) -> DataFrame:
    """Entries of a source's cursor (source_system, external_id) whose document the index does not have."""
    return cursor.join(documents.select("source_system", "external_id"), ["source_system", "external_id"], "left_anti")


def case_failures(cases: DataFrame, question: str, shipped: int = 8, pool: int = 20) -> DataFrame:
    """Why a case failed. cases: expect_abstain, abstained, answered_right, rank (of the first relevant, in a deep list)."""
    c = F.col
    why = (F.when(c("expect_abstain"), F.when(~c("abstained"), "false_answer")).when(c("rank").isNull(), "unreachable").when(c("rank") > pool, "candidate")
           .when(c("rank") > shipped, "ranking").when(c("abstained"), "abstention").when(~c("answered_right"), "answer"))
    return cases.select(question, why.alias("failure"))


def nearest_heading(lines: DataFrame, key: str) -> DataFrame:
    """Each line of Markdown texts (key, n, line) with the heading in effect there; fences are the caller's to mask."""
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*#*$", 1))
    return lines.withColumn("heading", F.last(heading, ignorenulls=True).over(w))
