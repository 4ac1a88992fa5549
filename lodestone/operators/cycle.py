"""The loop around the index: what is known of it as small tables, and one cycle of looking, judging, deciding and acting."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .incremental import actions, budgeted, corpus_actions
from .index import append_journal


def set_meta(spark: SparkSession, path: str, values: dict[str, Any]) -> None:
    """Values by key, as JSON: each call adds a file, so a reader sees all of a call or nothing of it."""
    rows = [(k, json.dumps(v, sort_keys=True)) for k, v in sorted(values.items())]
    stamped = spark.createDataFrame(rows, "key string, value string").coalesce(1).withColumn("at", F.current_timestamp()).withColumn("n", F.lit(_versions(spark, path)))
    stamped.write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _versions(spark: SparkSession, path: str) -> int:
    return (spark.read.parquet(path).agg(F.max("n")).first()[0] or 0) + 1 if _exists(spark, path) else 1


def get_meta(spark: SparkSession, path: str, key: str, default: Any = None) -> Any:
    """The value set last."""
    if not _exists(spark, path):
        return default
    row = spark.read.parquet(path).where(F.col("key") == key).agg(F.max_by("value", "n")).first()
    return default if row[0] is None else json.loads(row[0])


def cursor_of(documents: DataFrame) -> DataFrame:
    """What a source's next run compares with: (source_system, external_id, content_hash) of all that is indexed."""
    return documents.select("source_system", "external_id", "content_hash")


def cycle(spark: SparkSession, journal: str, number: int, situation: DataFrame, health: DataFrame, source: str, acts: dict[str, Callable[[str | None], Any]], budget: int = 6) -> list[dict]:
    """One cycle over a one-row situation and a table of sources' health: rules give actions, the budget's first are run in
    order of priority, each phase is written to the journal. An action that fails is recorded and does not stop the others.
    What is collected is the situation and no more actions than the budget has."""
    seen = situation.first().asDict()
    append_journal(spark, journal, number, "observe", json.loads(json.dumps(seen, default=str)))
    corpus = corpus_actions(situation).select(F.lit(None).cast("string").alias("source"), "kind", "priority")
    per_source = actions(health, source).select(F.col(source).cast("string").alias("source"), "kind", "priority")
    found = corpus.unionByName(per_source)
    # a quiet corpus says so only if no source has anything either
    found = found.where(F.col("kind") != "noop").unionByName(found.where("kind = 'noop'").limit(1 if per_source.isEmpty() else 0))
    append_journal(spark, journal, number, "orient", {"actions": {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}})
    chosen = [r.asDict() for r in budgeted(found, ["kind", "source"], budget).orderBy("seq").collect()]
    append_journal(spark, journal, number, "decide", {"chosen": [[r["kind"], r["source"]] for r in chosen if not r["deferred"]], "deferred": any(r["deferred"] for r in chosen)})
    done = []
    for r in chosen:
        if r["deferred"]:
            continue
        act = acts.get(r["kind"])
        try:
            outcome, error = (act(r["source"]) if act else None), None if act or r["kind"] == "noop" else "no such action"
        except Exception as e:  # an action is the caller's code
            outcome, error = None, str(e)
        done.append({"kind": r["kind"], "source": r["source"], "outcome": outcome, "error": error})
    append_journal(spark, journal, number, "act", {"done": json.loads(json.dumps(done, default=str))})
    return done


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON, one object a row."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode("overwrite").text(path)


def as_markdown(report: DataFrame, most: int = 1000) -> str:
    """A report's first rows as a Markdown table; reports have few."""
    rows = [["" if v is None else str(v).replace("|", "\\|") for v in r] for r in report.limit(most).collect()]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in [report.columns, ["---"] * len(report.columns), *rows])
