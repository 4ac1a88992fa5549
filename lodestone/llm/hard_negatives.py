"""Hard negatives of anchors by a blocked matrix multiply.

Vectors are multiplied in two dimensions of blocks: anchors in blocks of ANCHORS, all rows in blocks of ROWS, and both in
chunks of DIMS components. A grid cell (r, s) meets the anchor blocks of shard r and the row blocks of shard s, chunk by
chunk; each meeting makes a partial tile of int64 scores. Partial tiles are shuffled by (anchor block, row block) and
added up. Of each whole tile the best POSITIVES rows of the anchor's label are kept, then of all tiles; with these known
each tile gives, for each anchor and positive, the best NEGATIVES rows of other labels whose score lies in the window
from `low` to `high` percent of the positive's, and again the best of all tiles are kept. So a task holds a few tiles,
whatever labels, ids and copies repeat, and nothing but block counts passes through the driver.

The scores are as many as anchors times rows. What an executor holds does not grow with them: anchors go in passes of at
most PASS_BYTES of partial tiles, whose files go before the next pass, and each task of a pass makes or adds up about
PART_BYTES. A tile is a row of some hundred KB, two bytes a score where scores allow it (`packed`); such rows are handed to
Python BATCH_BYTES at a time and written in row groups of ROW_GROUP, since Spark holds a whole group when it reads them.

Components are integers: floor(scale * x). Scores are exact: products run in float64 where no sum can leave its 53 bits,
else in int64. Vectors so large that a score could leave int64 are refused with an error.

Rows with a null label, a null vector or a null or non-finite component take no part. Vectors of different lengths are
multiplied as if the shorter one went on with zeros; an empty one scores 0. Rows that repeat count as rows: the other one
is a positive like any other, and an anchor there twice is answered twice. A null id is no anchor, and comes last in ties;
ties of score and id are broken by place in the table. An empty table, or one without anchors, gives no rows. Columns
other than the three named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BROADCAST_ROWS, cut, discarded, grouped, lean, staged

ANCHORS, ROWS, DIMS = 64, 2048, 32
#: Blocks of either side in a cell of the grid.
CELL = 4
#: Bytes of partial tiles in a pass and in a task, at SCORE_BYTES a score (scores mostly take half of that).
PASS_BYTES, PART_BYTES, SCORE_BYTES = 6 << 30, 32 << 20, 4
#: Bytes of rows that hold blocks or tiles: handed to Python at once, and in a row group of a file.
BATCH_BYTES, ROW_GROUP = 8 << 20, 16 << 20
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90

_TILE = "a_block long, b_block long, chunk int, a_place binary, a_label binary, a_id array<long>, b_place binary, b_label binary, b_id array<long>, tile binary"


def prepared(vectors: DataFrame, anchor: Column, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """Rows that take part: place (distinct), id, label, anchor, q (integer components)."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
                          F.when(fine, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))).alias("q"),
                          F.monotonically_increasing_id().alias("place")).where("label is not null and q is not null")


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds almost all of them; the places and values of the others follow."""
    x = np.ascontiguousarray(x, np.int64).ravel()
    for kind in (np.int16, np.int32, np.int64):
        low = x.astype(kind)
        far = np.flatnonzero(low != x)
        if len(far) <= len(x) // 16:
            break
    return b"".join(part.tobytes() for part in (np.array([low.itemsize, len(x)]), low, far, x[far]))


def unpacked(data: pa.Buffer | bytes) -> np.ndarray:
    """What `packed` was given, in one dimension."""
    width, n = np.frombuffer(data, np.int64, 2).tolist()
    x = np.frombuffer(data, f"i{width}", n, 16).astype(np.int64)
    far, value = np.frombuffer(data, np.int64, offset=16 + width * n).reshape(2, -1)
    x[far] = value
    return x


def blocks(rows: DataFrame, many: int, dims: int) -> DataFrame:
    """The rows as `many` blocks in chunks of components: block, chunk, payload (`packed`, row by row), and with the first
    chunk the rows' places, labels and ids, in the order of ids and places."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, "block"):
            q = g.column(4)
            size = np.diff(q.offsets.to_numpy())
            wide = max(1, int(size.max()))
            matrix = np.zeros((g.num_rows, wide), np.int64)
            matrix[np.arange(wide) < size[:, None]] = q.flatten().to_numpy(zero_copy_only=False)
            for k, at in enumerate(range(0, wide, dims)):
                first = [g.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes() if not k else b"" for c in (1, 2)]
                ids = [g.column(3).to_pylist() if not k else []]
                yield pa.record_batch({"block": g.column(0).slice(0, 1), "chunk": pa.array([k], pa.int32()), "place": pa.array(first[:1], pa.binary()), "label": pa.array(first[1:], pa.binary()), "id": pa.array(ids, pa.list_(pa.int64())),
                                       "rows": pa.array([g.num_rows], pa.int32()), "payload": pa.array([packed(matrix[:, at : at + dims])], pa.binary())})

    dealt = rows.select(F.pmod(F.xxhash64("place"), F.lit(many)).cast("long").alias("block"), "place", "label", "id", "q")
    dealt = dealt.repartition("block").sortWithinPartitions("block", F.col("id").asc_nulls_last(), "place")
    return dealt.mapInArrow(run, "block long, chunk int, place binary, label binary, id array<long>, rows int, payload binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact in int64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def _side(rows: DataFrame, many: int, dims: int, name: str) -> DataFrame:
    t = blocks(rows, many, dims)
    return staged(t.select(*[F.col(c).alias(f"{name}_{c}") if c != "chunk" else F.col(c) for c in t.columns]), f"{name}-blocks", ROW_GROUP)


def score_tiles(a: DataFrame, b: DataFrame, a_blocks: int, b_blocks: int, parts: int) -> tuple[DataFrame, int]:
    """Whole tiles of scores, one row for each anchor block of a and row block of b, and the number of row shards."""
    r, s = -(-a_blocks // CELL), -(-b_blocks // CELL)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = a.withColumn("r", F.col("a_block") % r).withColumn("s", every(s)).repartition(parts, "r", "s", "chunk")
    b = b.withColumn("s", F.col("b_block") % s).withColumn("r", every(r)).repartition(parts, "r", "s", "chunk")
    meets = a.join(b.hint("shuffle_merge"), ["r", "s", "chunk"]).select("a_block", "b_block", "chunk", "a_place", "a_label", "a_id", "b_place", "b_label", "b_id", "a_rows", "a_payload", "b_rows", "b_payload")

    @lean
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                a, b = (unpacked(row.column(i)[0].as_buffer()).reshape(row.column(i - 1)[0].as_py(), -1) for i in (10, 12))
                wide = min(a.shape[1], b.shape[1])  # the shorter one goes on with zeros
                yield pa.record_batch([*row.columns[:9], pa.array([packed(product(a[:, :wide], b[:, :wide]))], pa.binary())], names=[f.split()[0] for f in _TILE.split(", ")])

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = None, np.zeros(0, np.int64)

        def whole() -> pa.RecordBatch:
            return pa.record_batch([*head.columns[:9], pa.array([packed(total)], pa.binary())], names=head.schema.names)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                part = unpacked(row.column(9)[0].as_buffer())
                if head is not None and head.column(0)[0] == row.column(0)[0] and head.column(1)[0] == row.column(1)[0]:
                    total = total + part
                    continue
                if head is not None:
                    yield whole()
                # the first chunk, which comes first, names the rows
                head, total = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in row.columns], names=row.schema.names), part
        if head is not None:
            yield whole()

    partial = meets.mapInArrow(multiply, _TILE).repartition(parts, "a_block", "b_block").sortWithinPartitions("a_block", "b_block", "chunk")
    return staged(partial.mapInArrow(add, _TILE).drop("chunk"), "score-tiles", ROW_GROUP), s


def _first(scores: np.ndarray, may: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the first `most` places that `may` allows, greatest first, ties in their order: row, place."""
    if scores.shape[1] > most:
        got = np.where(may, scores, np.iinfo(np.int64).min)
        may = may & (got >= np.partition(got, -most, axis=1)[:, -most, None])
    i, k = np.nonzero(may)
    order = np.lexsort((k, -scores[i, k], i))
    i, k = i[order], k[order]
    near = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[near], k[near]


def _tile(batch: pa.RecordBatch, k: int) -> tuple:
    a_place, a_label, b_place, b_label = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in (2, 3, 5, 6))
    scores = unpacked(batch.column(8)[k].as_buffer()).reshape(len(a_place), len(b_place))
    return a_place, a_label, batch.column(4)[k].values, b_place, b_label, batch.column(7)[k].values, scores


def _best(found: DataFrame, of: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mined(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, sizes: tuple[int, int, int] = (ANCHORS, ROWS, DIMS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: which rows are anchors."""
    _lower_batches(vectors.sparkSession)
    rows = staged(prepared(vectors, anchor, vec_id, vector, F.col("label") if label is None else label, scale), "vectors")
    about = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("q")), F.max(F.array_max("q")), F.min(F.array_min("q"))).first()
    total, anchors, wide, top, bottom = (v or 0 for v in about)
    if wide * max(abs(top), abs(bottom)) ** 2 >= 2**63:
        raise ValueError("scores of these vectors can leave 64 bits")
    in_a, in_b, dims = sizes
    a_blocks, b_blocks = max(1, -(-anchors // in_a)), max(1, -(-total // in_b))
    a, b = _side(rows.where("anchor"), a_blocks, dims, "a"), _side(rows, b_blocks, dims, "b")
    each = in_a * total * max(1, -(-wide // dims)) * SCORE_BYTES  # bytes of an anchor block's partial tiles
    step = max(1, PASS_BYTES // max(1, each))
    found: DataFrame | None = None
    for lo in range(0, a_blocks, step):
        many = min(step, a_blocks - lo)
        tiles, shards = score_tiles(a.where(F.col("a_block").between(lo, lo + many - 1)), b, many, b_blocks, max(1, -(-many * each // PART_BYTES)))
        best = staged(_of_tiles(tiles, shards, min(anchors, many * in_a), positives, negatives, low, high), "negatives")
        discarded(tiles)
        found = best if found is None else found.union(best)
    discarded(rows, a, b)
    return found


def _lower_batches(session: SparkSession) -> None:
    """At most BATCH_BYTES of rows go to Python at once from now on."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if session._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(session.conf.get(key)) > BATCH_BYTES:
        session.conf.set(key, f"{BATCH_BYTES}b")


def _of_tiles(tiles: DataFrame, shards: int, anchors: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """What `mined` returns, of anchors whose tiles these are."""

    @lean
    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a_place, a_label, a_id, b_place, b_label, b_id, scores = _tile(batch, k)
                for x in np.unique(a_label):
                    mine, own = np.flatnonzero(a_label == x), np.flatnonzero(b_label == x)
                    i, j = _first(scores[np.ix_(mine, own)], a_place[mine][:, None] != b_place[own], positives)
                    i, j = mine[i], own[j]
                    if len(i):
                        yield pa.record_batch({"a_block": pa.array(np.full(len(i), batch.column(0)[k].as_py())), "of": pa.array(i.astype(np.int32)), "anchor_place": pa.array(a_place[i]), "id": b_id.take(pa.array(j)), "place": pa.array(b_place[j]), "score": pa.array(scores[i, j])})

    kept = tiles.select("a_block", "b_block", "a_place", "a_label", "a_id", "b_place", "b_label", "b_id", "tile")
    found = kept.mapInArrow(same_label, "a_block long, of int, anchor_place long, id long, place long, score long")
    known = cut(_best(found, ["anchor_place"], positives).select("a_block", F.struct("of", "id", "place", "score").alias("p")))
    windows = known.groupBy("a_block").agg(F.sort_array(F.collect_list("p")).alias("positives"))
    if anchors * positives <= BROADCAST_ROWS:
        asked = kept.join(F.broadcast(windows), "a_block")
    else:  # every row shard gets the windows of an anchor block, so its tiles need not meet in one task
        spread = windows.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        asked = kept.withColumn("s", F.col("b_block") % shards).join(spread.hint("shuffle_merge"), ["a_block", "s"])

    @lean
    def other_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least_of, most_of = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        for batch in batches:
            for k in range(batch.num_rows):
                a_place, a_label, a_id, b_place, b_label, b_id, scores = _tile(batch, k)
                asked = [(p, max(least_of, -(-low * p["score"] // 100)), min(most_of, high * p["score"] // 100)) for p in batch.column(9)[k].as_py()]
                asked = [(p, least, most) for p, least, most in asked if least <= most]
                if not asked:
                    continue
                of = np.array([p["of"] for p, _, _ in asked])
                least, most = (np.array([x[c] for x in asked], np.int64)[:, None] for c in (1, 2))
                near = scores[of]
                n, j = _first(near, (near >= least) & (near <= most) & (a_label[of][:, None] != b_label), negatives)
                if len(n):
                    place, i, score = (pa.array([p[c] for p, _, _ in asked], pa.int64()) for c in ("place", "id", "score"))
                    at = pa.array(n)
                    yield pa.record_batch({"anchor_place": pa.array(a_place[of[n]]), "anchor_id": a_id.take(pa.array(of[n])), "positive_place": place.take(at), "positive_id": i.take(at), "positive_score": score.take(at), "id": b_id.take(pa.array(j)), "place": pa.array(b_place[j]), "score": pa.array(near[n, j])})

    asked = asked.select("a_block", "b_block", "a_place", "a_label", "a_id", "b_place", "b_label", "b_id", "tile", "positives")
    rest = asked.mapInArrow(other_label, "anchor_place long, anchor_id long, positive_place long, positive_id long, positive_score long, id long, place long, score long")
    best = _best(rest, ["anchor_place", "positive_place"], negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
