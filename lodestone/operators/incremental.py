"""Snapshots: what changed at a source, upserts and deletions as rewrites, health, and the rules that act on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import small_side


def delta(previous: DataFrame, current: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """Every key of either snapshot (keys, digest) with its status: new, changed, unchanged or removed."""
    a = previous.select(*keys, F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    b = current.select(*keys, F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    status = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def delta_counts(changes: DataFrame, source: str, failed: Column | None = None) -> DataFrame:
    """Counters of each source. Where reading failed anywhere, nothing counts as removed: it may only be unread."""
    names = ("new", "changed", "unchanged", "removed")
    bad = failed if failed is not None else F.lit(False)
    out = changes.groupBy(source).agg(*[F.count(F.when(F.col("status") == n, 1)).alias(n) for n in names], F.count(F.when(bad, 1)).alias("failed"))
    return out.withColumn("removed", F.when(F.col("failed") == 0, F.col("removed")).otherwise(F.lit(0)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows put in their places; columns in keep stay as they were where the key was known."""
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keys else (F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in keep else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without any row of a key that new has, and new's rows: delete-then-insert as a rewrite."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def deleted(key: str, gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the keys that are gone: a cascade is one anti-join for each table."""
    return [t.join(gone.select(key).distinct(), key, "left_anti") for t in tables]


def pruned(docs: DataFrame, gone: DataFrame, key: str, source: str, most: float = 0.25) -> DataFrame:
    """docs without what its source removed, but for sources that would lose more than a share: these stay whole."""
    marked = docs.join(gone.select(key, F.lit(True).alias("_gone")).distinct(), key, "left")
    share = marked.groupBy(source).agg((F.count("_gone") / F.count("*")).alias("_share"))
    return marked.join(small_side(share), source).where(F.col("_gone").isNull() | (F.col("_share") > most)).select(*docs.columns)


def needs_refit(documents: int, text_bytes: int, fitted_documents: int | None, fitted_bytes: int | None, by: float = 0.25) -> bool:
    """Whether term statistics no longer describe the corpus: never fitted, grown, or rewritten by more than a share."""
    if not fitted_documents:
        return True
    return (documents - fitted_documents) / fitted_documents > by or bool(fitted_bytes) and abs(text_bytes - fitted_bytes) / fitted_bytes > by


def source_health(runs: DataFrame, source: str, at: str, failed: str, now: Column) -> DataFrame:
    """From one row a run: runs, failure rate, failures since the last success, and hours since it (999 if never).
    The last success is an aggregate, so a source's runs are combined map-side whatever their number."""
    ok = F.max(F.when(~F.col(failed), F.col(at)))
    last = runs.groupBy(source).agg(F.count("*").alias("runs"), F.round(F.avg(F.col(failed).cast("double")), 4).alias("failure_rate"), ok.alias("last_success"))
    since = runs.join(small_side(last.select(source, "last_success")), source).where(F.col(failed) & (F.col("last_success").isNull() | (F.col(at) > F.col("last_success"))))
    streak = since.groupBy(source).agg(F.count("*").alias("consecutive_failures"))
    hours = F.when(F.col("last_success").isNull(), 999.0).otherwise(F.round(F.timestamp_diff("MICROSECOND", F.col("last_success"), now) / 3.6e9, 2))
    return last.join(streak, source, "left").select(source, "runs", "failure_rate", F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), hours.alias("hours_since_success"))


def merged_health(history: DataFrame, now: DataFrame, source: str) -> DataFrame:
    """history with now's rows instead of its own: a source that did not run keeps its record."""
    return replaced(history, now, source)


def actions(health: DataFrame, source: str, failures: int = 3, rate: float = 0.25, stale: float = 24.0) -> DataFrame:
    """What each source's health calls for: (source, kind, priority). Quarantine excludes the two rules after it."""
    bad = F.col("consecutive_failures") >= failures
    rules = F.array(
        F.when(F.coalesce(F.col("removed"), F.lit(0)) > 0, F.struct(F.lit("prune_removed").alias("kind"), F.lit(85).alias("priority"))),
        F.when(bad, F.struct(F.lit("quarantine_source").alias("kind"), F.lit(80).alias("priority"))),
        F.when(~bad & (F.col("failure_rate") > rate), F.struct(F.lit("alert").alias("kind"), F.lit(60).alias("priority"))),
        F.when(~bad & (F.col("hours_since_success") > stale), F.struct(F.lit("backfill_source").alias("kind"), F.lit(50).alias("priority"))),
    )
    have = health if "removed" in health.columns else health.withColumn("removed", F.lit(0))
    return have.select(source, F.explode(F.filter(rules, lambda a: a.isNotNull())).alias("a")).select(source, "a.kind", "a.priority")


def corpus_actions(situation: DataFrame) -> DataFrame:
    """Actions for one-row situations: coverage, mismatch, growth, pass rates, content; noop where none applies."""
    c = F.col
    rule = lambda when, kind, priority: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority")))
    rules = F.filter(F.array(
        rule(c("coverage") < 0.99, "embed_missing", 100), rule(c("fingerprint_mismatch"), "reindex", 95),
        rule(c("previous_pass_rate") - c("pass_rate") > 0.05, "alert", 92), rule(c("pass_rate") < 0.8, "alert", 90),
        rule(c("growth") > 0.25, "refit_embedder", 70), rule(c("degradation").isNotNull() & ~c("degradation").startswith("All probed"), "alert", 40),
        rule(c("content_changed") & (c("documents") >= 5), "run_eval", 30),
    ), lambda a: a.isNotNull())
    noop = F.array(F.struct(F.lit("noop").alias("kind"), F.lit(0).alias("priority")))
    return situation.select("*", F.explode(F.when(F.size(rules) > 0, rules).otherwise(noop)).alias("a")).select(*situation.columns, "a.kind", "a.priority")


def budgeted(found: DataFrame, order: list, budget: int = 6) -> DataFrame:
    """The first actions by priority, and one row for the first that has to wait: a limit by order, of which each
    partition keeps no more than it may need, and numbers for what is left."""
    first = found.orderBy(F.desc("priority"), *order).limit(budget + 1)
    ranked = first.withColumn("seq", F.row_number().over(Window.orderBy(F.desc("priority"), *order)))
    return ranked.withColumn("deferred", F.col("seq") > budget)


def first_of_equal(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """One row for each digest, the first in order; by aggregates, so frequent digests are combined map-side."""
    rest = [c for c in df.columns if c not in order and c != digest]
    row = F.struct(*order, *rest)
    return df.groupBy(digest).agg(F.min(row).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) if c != digest else F.col(digest) for c in df.columns])


def carried_forward(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Each row's latest value at or before it, within its key. Rows are sorted over ranges of (key, order), so a key with
    any share of all rows is spread; a range begins with what the last value of its first key was in the ranges before."""
    from .staging import shared_folder

    shared_folder(df.sparkSession)
    ranged = df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    has = F.col(value).isNotNull()
    last = ranged.where(has).groupBy(key, "_part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    # one row for each key and range that holds it; carried from range to range
    held = ranged.select(key, "_part").distinct().join(last, [key, "_part"], "left")
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("_before", F.last("_last", ignorenulls=True).over(w)).select(key, "_part", "_before").where("_before is not null")
    w = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(small_side(before), [key, "_part"], "left").withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("_before"))).select(*[c for c in df.columns if c != out], out)
