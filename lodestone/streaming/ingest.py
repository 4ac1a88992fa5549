"""Incremental ingest: each micro-batch of raw documents is compared with the snapshot, of which it rewrites what it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import redaction, text as T
from ..operators.incremental import delta, first_of_equal, upsert
from ..operators.staging import small_side, staged

KEYS = ["source_system", "external_id"]


def normalized(raw: DataFrame) -> DataFrame:
    """Raw documents (source_system, external_id, uri, title, text) cleaned, redacted and identified."""
    text = redaction.redact(T.clean(F.coalesce("text", F.lit(""))))
    return raw.select(*KEYS, redaction.redact(F.col("uri")).alias("uri"), redaction.redact(F.col("title")).alias("title"), text.alias("text")).withColumn("doc_id", T.stable_id(F.col("source_system"), F.col("external_id"))).withColumn("content_hash", T.content_hash(F.col("title"), F.col("text")))


class Snapshots:
    """Numbered snapshots of a table under a folder, each of which rewrites only the parts that it touches.

    Rows lie in parts by a hash of their key. A snapshot writes its parts to a folder of its own, then a manifest: which
    version of each part it is made of. It counts once the manifest is written, so readers never see half of one, a batch
    that is run again starts from the snapshot before, and earlier snapshots stay readable until ``vacuum``."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", parts: int = 64):
        self.spark, self.folder, self.key, self.parts = spark, folder.rstrip("/"), key, parts

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _numbers(self, path: str, prefix: str) -> list[int]:
        files, place = self._fs(path)
        return sorted(int(s.getPath().getName().removeprefix(prefix)) for s in files.listStatus(place) if s.getPath().getName().startswith(prefix)) if files.exists(place) else []

    def latest(self) -> int | None:
        """The newest snapshot that is written whole."""
        done = lambda n: (lambda f: f[0].exists(f[1]))(self._fs(f"{self.folder}/manifest/snapshot={n:08d}/_SUCCESS"))
        return max((n for n in self._numbers(f"{self.folder}/manifest", "snapshot=") if done(n)), default=None)

    def manifest(self, n: int) -> dict[int, int]:
        """Of each part that has rows, the snapshot that wrote it: as many rows as there are parts."""
        rows = self.spark.read.schema("part int, version int").parquet(f"{self.folder}/manifest/snapshot={n:08d}")
        return {r["part"]: r["version"] for r in rows.collect()}

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def read(self, n: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """A snapshot (the latest), or some of its parts; None if there are no rows."""
        n = self.latest() if n is None else n
        held = {} if n is None else self.manifest(n)
        paths = [f"{self.folder}/data/version={v:08d}/part={p}" for p, v in sorted(held.items()) if only is None or p in only]
        return self.spark.read.parquet(*paths) if paths else None

    def touched(self, rows: DataFrame) -> set[int]:
        """The parts that rows belong to."""
        return {r["part"] for r in rows.select(self.part().alias("part")).distinct().collect()}

    def write(self, rows: DataFrame, n: int, before: int | None = None, touched: set[int] | None = None) -> None:
        """Snapshot n: of the snapshot before, with all rows of the touched parts (all parts, if not given) anew."""
        data = f"{self.folder}/data/version={n:08d}"
        rows.withColumn("part", self.part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(data)
        kept = {p: v for p, v in self.manifest(before).items() if p not in touched} if before is not None and touched is not None else {}
        made = kept | {p: n for p in self._numbers(data, "part=")}
        self.spark.createDataFrame([*made.items()], "part int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/snapshot={n:08d}")

    def vacuum(self, keep: int = 1) -> list[int]:
        """Deletes all but the newest snapshots, and versions of parts that none of these has. Returns what went."""
        newest = [n for n in self._numbers(f"{self.folder}/manifest", "snapshot=") if n <= (self.latest() or 0)][-keep:]
        used = {v for n in newest for v in self.manifest(n).values()}
        gone = [v for v in self._numbers(f"{self.folder}/data", "version=") if v not in used and v <= (self.latest() or -1)]
        for path in [f"data/version={v:08d}" for v in gone] + [f"manifest/snapshot={n:08d}" for n in self._numbers(f"{self.folder}/manifest", "snapshot=") if n < min(newest, default=0)]:
            files, place = self._fs(f"{self.folder}/{path}")
            files.delete(place, True)
        return gone


def merge_batch(store: Snapshots, on_delta: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. A batch reads and rewrites only the parts its documents are in. One that is run again writes the
    snapshot of its own number again, from the one before."""

    def run(batch: DataFrame, number: int) -> None:
        new = first_of_equal(normalized(batch), "doc_id", ["content_hash", *KEYS]).select("doc_id", *KEYS, "uri", "title", "text", "content_hash")
        new = staged(new, "batch")
        have = store.latest()
        before = have if have is not None and have < number else number - 1 if have is not None and number else None
        if before is None:
            store.write(new, number)
            return
        touched = store.touched(new)
        old = store.read(before, touched)
        old = new.limit(0) if old is None else old
        if on_delta:
            on_delta(delta(old.join(small_side(new.select("doc_id")), "doc_id", "left_semi"), new, KEYS).where("status <> 'removed'"), number)
        store.write(upsert(old, new, ["doc_id"]), number, before, touched)

    return run


def ingest(stream: DataFrame, store: Snapshots, checkpoint: str, on_delta: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Takes all that is there and ends; the checkpoint remembers what was taken."""
    return stream.writeStream.foreachBatch(merge_batch(store, on_delta)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
