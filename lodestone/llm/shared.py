"""What several operators need: tables cut from their lineage, and groups of linked nodes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has no more rows than this (of a few longs each).
BROADCAST_ROWS = 500_000

#: Keys of a join with more rows than LIGHT_ROWS and than a share 1 / HEAVY_KEYS of all rows are met by broadcast.
LIGHT_ROWS, HEAVY_KEYS = 256, 100_000

#: Links of two longs each that one task holds.
SMALL_GRAPH = 200_000

#: Rows of a few longs for which a partition of its own is worth its files.
PART_ROWS = 10_000

#: Rows that Spark hands to Python at once: texts are some KB each, and each task holds a few batches outside the heap.
BATCH_ROWS = 2000


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function that leaves no freed memory behind in its worker. Where it is defined, on the driver, it also
    lowers the session's rows per Arrow batch to BATCH_ROWS."""
    session = SparkSession.getActiveSession()
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if session and not 0 < int(session.conf.get(rows, "10000")) <= BATCH_ROWS:
        session.conf.set(rows, str(BATCH_ROWS))

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass

    return wrapped


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows of equal key, which follow one another, as one batch each; of rows across batches only one key's are held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = b.slice(lo, hi - lo)
            if held and held[0].column(b.schema.get_field_index(key))[0] != part.column(b.schema.get_field_index(key))[0]:
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local session (tests) gets a folder of its
    own; a cluster is refused, since its machines would not see that folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later jobs start from these files. They go when the
    driver ends, or before by ``discarded``. row_group: bytes in a row group, for rows of many KB: sizes are then looked at
    row by row, not every hundred rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    small = {"parquet.block.size": row_group, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if row_group else {}
    df.write.option("compression", "zstd").options(**small).parquet(path)
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def discarded(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing will read any more: what was made of them is written itself."""
    for t in tables:
        files, place = _files(t.sparkSession, t.staged_at)
        files.delete(place, True)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a reliable checkpoint, for small tables that are used several times. rows: how many it has at most, where that
    is known: it then has no more partitions than they need, PART_ROWS each, and what follows no more files."""
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(4, -(-rows // PART_ROWS)))).checkpoint(eager=True)


def semi_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct): by broadcast if ids are few enough, else by a shuffled join."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_merge"), key, "left_semi")


def met(big: DataFrame, small: DataFrame, key: list[str], rows: str, how: str = "inner") -> DataFrame:
    """big joined with small, which has one row a key and in `rows` how many rows of big have that key. Keys of many
    rows never share a task: those that have more than a share 1 / HEAVY_KEYS of all rows, so fewer than HEAVY_KEYS of
    them, are broadcast; the rest is joined by shuffle. If small has no more rows than that, all of it is broadcast."""
    about = small.agg(F.sum(rows).alias("rows"), F.count("*").alias("keys")).first()
    if about["keys"] <= HEAVY_KEYS:
        return big.join(F.broadcast(small), key, how)
    total = about["rows"] or 0
    heavy = F.col(rows) > max(LIGHT_ROWS, total // HEAVY_KEYS)
    few = F.broadcast(small.where(heavy))
    light = big.join(F.broadcast(small.where(heavy).select(*key)), key, "left_anti")
    return big.join(few, key).unionByName(light.join(small.where(~heavy).hint("shuffle_merge"), key, how), allowMissingColumns=True)


def linked_groups(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root being the smallest node of the group.

    Alternates two steps until nothing changes: every node's larger neighbours go to its smallest one, then its
    smaller ones do. The number of rounds grows with the logarithm of the longest chain. Null ends are ignored. Nodes
    with very many neighbours are met by broadcast (``met``), so that none of them fills one task.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b")
            .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    n = e.count()
    # a graph of a few MB is grouped and joined in one task a step, a larger one over partitions
    near = (lambda df: df.coalesce(1)) if n <= SMALL_GRAPH else (lambda df: df)
    e = near(e) if n <= SMALL_GRAPH else e.coalesce(-(-n // PART_ROWS))
    for _ in range(max_rounds):
        if not n:
            break
        both = near(e.select(F.col("hi").alias("v"), "lo").union(e.select(F.col("lo").alias("v"), F.col("hi").alias("lo"))))
        least = near(cut(both.groupBy("v").agg(F.min("lo").alias("m"), F.count("*").alias("_rows")).select("v", F.least("v", "m").alias("m"), "_rows"), 2 * n))
        wide = near(cut(near(met(both, least, ["v"], "_rows").where("lo > v and lo <> m").select(F.col("lo").alias("v"), F.col("m").alias("lo"))
                             .union(least.where("v <> m").select("v", F.col("m").alias("lo")))).distinct(), 2 * n))
        low = near(cut(wide.groupBy("v").agg(F.min("lo").alias("m"), F.count("*").alias("_rows")), 2 * n))
        new = near(cut(near(met(wide, low, ["v"], "_rows").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                            .union(low.select(F.col("v").alias("hi"), F.col("m").alias("lo")))).distinct(), 2 * n))
        many = new.count()
        settled = many == n and new.join(F.broadcast(e) if n <= HEAVY_KEYS else e, ["hi", "lo"], "left_anti").isEmpty()
        e, n = new, many
        if settled:
            break
    else:
        raise RuntimeError("the groups did not settle")
    nodes = near(e).groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
