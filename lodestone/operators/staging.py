"""Tables cut from their lineage, and sides that are broadcast only if their size is known."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a side's files that may be broadcast; as rows in memory they are some ten times as many.
BROADCAST_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session (tests) makes one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def released(df: DataFrame) -> None:
    """Deletes the files of a table that was staged and that nothing reads any more."""
    files, place = _files(df.sparkSession, df.staged_at)
    files.delete(place, True)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def sized(df: DataFrame, most: int | None = None) -> tuple[DataFrame, bool]:
    """df, made once: written to the shared folder and read again (a table that was staged before is not written again);
    and whether its files have at most `most` bytes (BROADCAST_BYTES)."""
    kept = df if hasattr(df, "staged_at") else staged(df, "side")
    files, place = _files(kept.sparkSession, kept.staged_at)
    return kept, files.getContentSummary(place).getLength() <= (BROADCAST_BYTES if most is None else most)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df, made once; and what gives a broadcast hint to a side that has no more rows than df, or does nothing if df's files
    have more than `most` bytes, so that such sides are joined by shuffle."""
    kept, few = sized(df, most)
    return kept, F.broadcast if few else lambda side: side


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, made once, with a broadcast hint if it is small."""
    kept, hint = bounded(df, most)
    return hint(kept)


def running_sums(df: DataFrame, order: str, sums: dict[str, str], inclusive: bool = True) -> DataFrame:
    """df with the sums of columns over all rows up to each (or before it), by a sort over ranges: each range adds up its
    own rows and what the ranges before it come to. sums: new column to column. Values of order are distinct."""
    shared_folder(df.sparkSession)
    ranged = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(sums.values())])
    # one row for each range, as many as there are partitions
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *[F.coalesce(F.sum(f"_t{k}").over(parts), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = ranged.join(F.broadcast(before), "_part")
    return out.select(*df.columns, *[(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_b{k}")).alias(name) for k, (name, c) in enumerate(sums.items())])
