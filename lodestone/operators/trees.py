"""Listings of files compared as hash trees: equal folders are never opened.

A listing is path and digest, such as a repository's blobs. Its tree has a row for each file and folder; a folder's digest is
made of all that is below it, by path and digest, so it does not depend on order and one aggregate makes all folders at once.
Two trees are compared from the root: at each level only the children of folders that differ are joined, and only folders
that differ again are opened at the next. What is read grows with what changed and the folders on the way to it, not with
the listing. Trees are kept as tables in folders by depth and, below that, by a hash of the parent, of which a level reads
those of the folders it opens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import small_side, staged

#: Folders by a hash of the parent at each depth.
SPLIT = 64
ROOT = ""
_TREE = "path string, parent string, is_file boolean, digest string, files long, depth int, split int"


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def tree(listing: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """path, parent, is_file, digest, files (how many are below) and depth of all files and folders; the root's path is
    empty, at depth 0. Of paths that repeat any one counts; null paths do not, a null digest is one of its own."""
    files = listing.select(F.col(path).alias("path"), F.coalesce(F.col(digest).cast("string"), F.lit("\x00")).alias("digest")).where("path is not null").dropDuplicates(["path"])
    names = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda d: F.struct(d.alias("depth"), F.when(d == 0, F.lit(ROOT)).otherwise(F.array_join(F.slice(names, 1, d), "/")).alias("folder")))
    each = files.select(F.xxhash64("path", "digest").alias("a"), F.xxhash64("digest", "path", F.lit(1)).alias("b"), F.explode(above).alias("f"))
    # sums without an order, combined where the files lie: the root's too
    folders = each.groupBy("f.folder", "f.depth").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("files"))
    folders = folders.select(F.col("folder").alias("path"), F.when(F.col("depth") > 0, _parent(F.col("folder"))).alias("parent"), F.lit(False).alias("is_file"), F.concat(F.hex("a"), F.lit("-"), F.hex("b")).alias("digest"), "files", F.col("depth").cast("int").alias("depth"))
    leaves = files.select("path", _parent(F.col("path")).alias("parent"), F.lit(True).alias("is_file"), "digest", F.lit(1).cast("long").alias("files"), F.size(names).cast("int").alias("depth"))
    return folders.unionByName(leaves)


def write_tree(nodes: DataFrame, folder: str) -> None:
    split = F.pmod(F.xxhash64(F.coalesce("parent", F.lit(""))), F.lit(SPLIT)).cast("int")
    nodes.withColumn("split", split).repartition("depth", "split").write.mode("overwrite").partitionBy("depth", "split").parquet(folder)


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_TREE).parquet(folder)


def _level(nodes: DataFrame, depth: int, opened: DataFrame | None) -> DataFrame:
    rows = nodes.where(F.col("depth") == depth)
    if opened is None:
        return rows
    if "split" in nodes.columns:
        # at most SPLIT numbers
        splits = [r["s"] for r in opened.select(F.pmod(F.xxhash64("path"), F.lit(SPLIT)).cast("int").alias("s")).distinct().collect()]
        rows = rows.where(F.col("split").isin(splits))
    return rows.join(small_side(opened.withColumnRenamed("path", "parent")), "parent", "left_semi")


def changed_files(old: DataFrame, new: DataFrame, read: list | None = None) -> DataFrame:
    """path and status (new, changed, removed) of the files that differ. read: gets, level by level, how many rows of both
    trees were compared. A path that was a file and is a folder now is removed, and what is below it new."""
    kind = "path string, status string"
    out, opened, depth = old.sparkSession.createDataFrame([], kind), None, 0
    while True:
        side = lambda t, name: _level(t, depth, opened).select("path", "is_file", F.col("digest").alias(name), F.lit(True).alias(f"in_{name}"))  # noqa: B023, E731
        both = staged(side(old, "old").join(side(new, "new"), ["path", "is_file"], "full_outer"), "level")
        if read is not None:
            # two numbers
            read.append(sum(v or 0 for v in both.agg(F.count("in_old"), F.count("in_new")).first()))
        differ = both.where(~F.col("old").eqNullSafe(F.col("new")))
        status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed").otherwise("changed")
        out = out.unionByName(differ.where("is_file").select("path", status.alias("status")))
        opened = staged(differ.where("not is_file").select("path"), "opened")
        if opened.isEmpty():
            return out
        depth += 1
