"""Incremental ingest as keyed state: what each source showed last, kept by Spark and restored after a restart.

Every document of a source is a key (source_system, external_id) with the hash of what was seen last and the run in which it
was seen. A run's documents come as rows with the run's number; when a run is over the source sends a row without an id and
with the number of failures. Each key then says new, changed, unchanged or removed:

- a row of a key is new if nothing is known of it, changed if its hash is another one, else unchanged; of rows of a key that
  arrive together in a run the one of the greatest hash counts;
- a key that a completed run did not show is removed, unless reading failed anywhere in that run: it may only be unread.

Removal needs all keys of a source, so a second state holds, for every bucket of a source, the hashes by id (a map). A
bucket is BUCKETS-th of a source by a hash of the id, so a source of any size is spread over tasks and a row of the end of a
run is sent to all of its buckets. With forget_after_ms, a bucket that nothing came for in that time is forgotten by a timer;
such a stream runs batches without data too, so it is for triggers by time, not for availableNow. State needs the RocksDB
provider (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Parts that a source's documents are kept in.
BUCKETS = 16
CHANGES = "source_system string, external_id string, run long, status string"
_KEY = StructType([StructField("external_id", StringType())])
_VALUE = StructType([StructField("content_hash", StringType()), StructField("run", LongType())])


class Seen(StatefulProcessor):
    """State of one bucket of a source: by id the hash, and the run in which it was seen last."""

    def __init__(self, forget_after_ms: int | None = None):
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", _KEY, _VALUE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        source = key[0]
        every = pd.concat(list(rows)).sort_values(["run", "content_hash"], kind="stable")
        out = []
        for run, part in every.groupby("run", sort=True):
            docs = part[part["external_id"].notna()].drop_duplicates("external_id", keep="last")
            for name, digest in zip(docs["external_id"], docs["content_hash"], strict=True):
                old = self.known.getValue((name,)) if self.known.containsKey((name,)) else None
                status = "new" if old is None else "unchanged" if old[0] == digest else "changed"
                self.known.updateValue((name,), (digest, int(run)))
                out.append((source, name, int(run), status))
            ends = part[part["external_id"].isna()]
            if len(ends) and not ends["failed"].fillna(0).sum():
                gone = [k[0] for k, v in self.known.iterator() if v[1] < run]
                for name in gone:
                    self.known.removeKey((name,))
                    out.append((source, name, int(run), "removed"))
        if self.forget_after_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_after_ms)
        yield pd.DataFrame(out, columns=["source_system", "external_id", "run", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came from the source for too long: what it had is forgotten, and would be new again."""
        self.known.clear()
        yield pd.DataFrame([], columns=["source_system", "external_id", "run", "status"])

    def close(self) -> None:
        pass


def changes(stream: DataFrame, forget_after_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """stream: source_system, external_id, content_hash, run (long) and failed (int, on rows that end a run, whose id is
    null). Gives source_system, external_id, run and status as they are known."""
    own = F.array(F.pmod(F.xxhash64("external_id"), F.lit(buckets)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    rows = stream.select("source_system", "external_id", "content_hash", F.col("run").cast("long").alias("run"), F.col("failed").cast("int").alias("failed"))
    dealt = rows.withColumn("bucket", F.explode(F.when(F.col("external_id").isNull(), every).otherwise(own)))
    return dealt.groupBy("source_system", "bucket").transformWithStateInPandas(Seen(forget_after_ms), outputStructType=StructType.fromDDL(CHANGES), outputMode="Append", timeMode="ProcessingTime" if forget_after_ms else "None")
