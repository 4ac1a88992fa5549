"""Text that a site's template puts on its pages: learned as lines frequent across documents, and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import lines_with_headings
from .staging import small_side


def learned(docs: DataFrame, source: str, doc: str, lines: Column, share: float = 0.5, least: int = 5) -> DataFrame:
    """(source, line, documents) of lines in at least a share of a source's documents, for sources of `least` or more."""
    n = docs.groupBy(source).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    each = docs.select(source, F.explode(F.array_distinct(F.transform(lines, lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    return each.groupBy(source, "line").agg(F.count("*").alias("documents")).join(small_side(n), source).where(F.col("documents") >= share * F.col("_n")).select(source, "line", "documents")


def with_known(template: DataFrame, known: DataFrame) -> DataFrame:
    """(source, line) learned now or known from before: what was removed once is not learned again from clean pages."""
    return template.select(*known.columns).unionByName(known).distinct()


def learned_headings(docs: DataFrame, source: str, text: str = "text", share: float = 0.5, least: int = 5) -> DataFrame:
    """(source, heading, documents) of headings in at least a share of a source's documents, for sources of `least` or
    more; each counts once a document."""
    n = docs.groupBy(source).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    each = lines_with_headings(docs, [source], text).where("is_heading").select("_row", source, F.element_at("chain", -1).alias("heading")).distinct()
    return each.groupBy(source, "heading").agg(F.count("*").alias("documents")).join(small_side(n), source).where(F.col("documents") >= share * F.col("_n")).select(source, "heading", "documents")


def without_sections(docs: DataFrame, template: DataFrame, source: str, text: str = "text") -> DataFrame:
    """docs without the sections whose heading is in the template (source, heading), each to the next heading of its level
    or a higher one; a section within one goes with it."""
    lists = template.groupBy(source).agg(F.collect_set("heading").alias("_template"))
    keep = [c for c in docs.columns if c != text]
    rows = lines_with_headings(docs, docs.columns, text).drop(text).join(small_side(lists), source, "left")
    stays = ~F.arrays_overlap("chain", F.coalesce("_template", F.array().cast("array<string>")))
    lines = F.sort_array(F.collect_list(F.when(stays, F.struct("n", "raw"))))
    out = rows.groupBy("_row").agg(*[F.first(c).alias(c) for c in keep], lines.alias("_l"))
    return out.withColumn(text, F.array_join(F.transform("_l", lambda x: x["raw"]), "")).select(*docs.columns)


def stripped(docs: DataFrame, template: DataFrame, source: str, text: str = "text") -> DataFrame:
    """docs without their source's template lines. A source's lines are at most 1/share of a document's, so its list is
    short and travels with each row."""
    lists = template.groupBy(source).agg(F.collect_set("line").alias("_template"))
    joined = docs.join(small_side(lists), source, "left")
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains("_template", F.trim(x)), F.lit(False)))
    return joined.withColumn(text, F.array_join(kept, "\n")).select(*docs.columns)
