"""Near-duplicate join: pairs of texts whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Chosen paths. A set's samples are the smallest of its n-gram hashes under independent orders; two sets share a sample
with the probability of their similarity. A run splits all sets by one sampled n-gram, then every bucket that is still
large by two further samples, chosen by the bucket's path, and so on until buckets are small. Small buckets are compared by
brute force. In large ones that splitting would not part (most members share the sample it splits by) members are linked
to representatives that they are like, and what is like none of them is split on. Runs are repeated, as many as the target
recall asks for, losses of the splits included; each takes other representatives. All of this only says what has to be
compared; the groups so linked are then compared by their exact sets, which gives each document's number of links and its
class.

Exact comparison of a large group begins with representatives: texts within half the distance that makes a link of one
representative are all linked to each other, since 1 - Jaccard similarity is a metric, so they are counted, not compared.
What no representative covers is compared, block by block, with all of the group, and so are the texts of different
representatives. The work is linear for a group of copies that are all close to a few texts, however large.

Texts with the same set of n-grams are one node, with a number of copies, before anything is compared. A text of fewer
words than n has one n-gram, all its words; null texts and texts without words have none, and so no links. Rows without
doc_id are returned with a null class and no links. Different texts of one id are different documents, each with the class
and links of its text. Rows that repeat count as documents, rows without doc_id as nobody's
link. Other columns are not read, whatever their names. An empty table gives an empty result. Memory is bounded by the
blocks compared, not by groups; a text of any length is taken whole, in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BROADCAST_ROWS, cut, discarded, grouped, lean, linked_groups, met, semi_by_id, staged
from .textarrays import Texts, mixed, ngram_hashes, text_slices, _P

THRESHOLD, WORDS, RECALL, LEAF, LEVELS = 0.8, 5, 0.99999, 256, 4
#: Samples besides each run's first: buckets choose among them what to split by, SPLITS at a time.
POOL, SPLITS = 48, 2
#: Representatives of a large group chosen at a time, and how often.
REPRESENTATIVES, ROUNDS = 4, 2


def recall_of_run(threshold: float, levels: int = LEVELS) -> float:
    """The least probability that a pair at the threshold meets in a run: it shares the first sample, and at each level
    at least one of those split by."""
    return threshold * (1 - (1 - threshold) ** SPLITS) ** levels


def runs_for(recall: float, threshold: float, levels: int = LEVELS) -> int:
    """Runs until a pair at the threshold is missed with a probability of at most 1 - recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - recall_of_run(threshold, levels))))


def ngram_sets(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of the texts of a slice, text by text, and the text of each."""
    words, owner = t.hashes(), t.owners()
    grams = ngram_hashes(words, n)
    inside = owner[n - 1 :] == owner[: len(grams)] if len(grams) else np.zeros(0, bool)
    h, o = grams[inside], owner[: len(grams)][inside]
    count = np.diff(t.word_bounds)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([mixed(ngram_hashes(words[t.word_bounds[i] : t.word_bounds[i + 1]], int(count[i])) + np.uint64(count[i]))[0] for i in short], np.uint64)
        h, o = np.concatenate([h, extra]), np.concatenate([o, short])
    _, at = np.unique(mixed(h + o.astype(np.uint64) * np.uint64(_P)), return_index=True)
    at = at[np.argsort(o[at], kind="stable")]
    return h[at], o[at]


def _ids_and_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    for b in batches:
        for t in text_slices(b):
            h, o = ngram_sets(t, n)
            size = np.bincount(o, minlength=t.n)
            full = np.flatnonzero(size)
            begin = np.concatenate([[0], np.cumsum(size)])
            keys = np.zeros((2, t.n), np.uint64)
            if len(full):
                keys[0, full] = np.add.reduceat(mixed(h), begin[full])
                keys[1, full] = np.add.reduceat(mixed(h ^ np.uint64(_P)), begin[full])
            yield b.column(0).slice(t.first, t.n), h, size, full, begin, keys.view(np.int64)


def _text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketches(docs: DataFrame, n: int, coordinates: int) -> DataFrame:
    """doc_id, a hash of the text, the set's identity (k1, k2) and size, and its samples, 4 bytes each."""
    orders = np.random.default_rng(5).integers(1, 2**62, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, size, full, begin, keys in _ids_and_sets(batches, n):
            sample = np.zeros((len(size), coordinates), np.uint32)
            for c in range(coordinates if len(full) else 0):
                sample[full, c] = (np.minimum.reduceat(h * orders[c], begin[full]) >> np.uint64(32)).astype(np.uint32)
            raw = sample.tobytes()
            width = 4 * coordinates
            yield pa.record_batch({"doc_id": ids.field(0), "text_hash": ids.field(1), "k1": pa.array(keys[0]), "k2": pa.array(keys[1]), "n": pa.array(size, pa.int32()), "samples": pa.array([raw[i * width : (i + 1) * width] for i in range(len(size))], pa.binary())})

    named = docs.select(F.struct(F.col("doc_id").cast("long"), _text_hash()).alias("name"), "text")
    return named.mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, n int, samples binary")


def labels_of(near: np.ndarray) -> np.ndarray:
    """The smallest member of each member's connected part, for a symmetric matrix of links."""
    n = len(near)
    label = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        if (new == label).all():
            return label
        label = new


def _paired_blocks(rows: DataFrame, key: str, node: str, blocks) -> DataFrame:
    """Rows dealt so that any two of a key meet in a group of at most two blocks; `group`, and `same` if it is of one."""
    own = F.pmod(F.xxhash64(node, F.lit(7)), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    return (rows.withColumn("_blocks", blocks.cast("long")).withColumn("_own", own).withColumn("_other", other)
            .withColumn("group", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other")))
            .withColumn("same", F.col("_own") == F.col("_other")).withColumn("block", F.col("_own")).drop("_blocks", "_own", "_other"))


def _like_representatives(rows: DataFrame, dense: DataFrame, classes: DataFrame, coordinates: int, floor: float) -> DataFrame:
    """(key, cid, ball) for members of large dense buckets: the representative of the bucket, one of a few, that shares
    enough samples with it, or none. rows: key, cid, size, of all large buckets; dense: key. Members meet their bucket
    once: the representatives alone are kept to dense buckets, and rows of other buckets meet none."""
    pick = rows.groupBy("key").agg(F.max("size").alias("_rows"), F.array_distinct(F.array(*[F.min_by("cid", F.xxhash64("cid", "key", F.lit(j))) for j in range(REPRESENTATIVES)])).alias("balls")).join(dense, "key", "left_semi")
    chosen = pick.select("key", "_rows", F.explode("balls").alias("cid")).join(classes.select("cid", "samples"), "cid")
    balls = cut(chosen.groupBy("key").agg(F.max("_rows").alias("_rows"), F.sort_array(F.collect_list(F.struct("cid", "samples"))).alias("b")).select("key", "_rows", F.col("b.cid").alias("of"), F.col("b.samples").alias("of_samples")))
    members = met(rows.select("key", "cid").join(classes.select("cid", "samples"), "cid"), balls, ["key"], "_rows").select("key", "cid", "samples", "of", "of_samples")

    @lean
    def like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(b.num_rows, coordinates)
            of, count = b.column(3), np.diff(b.column(3).offsets.to_numpy())
            other = np.frombuffer(b"".join(x for row in b.column(4).to_pylist() for x in row), np.uint32).reshape(-1, coordinates)
            owner = np.repeat(np.arange(b.num_rows), count)
            shared = (s[owner] == other).sum(1)
            ids = of.flatten().to_numpy(zero_copy_only=False)
            # the first of those that share most
            order = np.lexsort((ids, -shared, owner))
            first = order[np.searchsorted(owner[order], np.arange(b.num_rows))]
            yield pa.record_batch({"key": b.column(0), "cid": b.column(1), "ball": pa.array(ids[first], mask=shared[first] < floor)})

    return members.mapInArrow(like, "key long, cid long, ball long")


def candidate_links(classes: DataFrame, runs: int, threshold: float, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) that join whatever the runs' buckets show to be near the threshold or above. classes: cid, samples."""
    coordinates = runs + POOL
    floor = coordinates * (threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / coordinates))

    @lean
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, coordinates).astype(np.uint64)
            for r in range(runs):
                yield pa.record_batch({"key": pa.array(mixed(s[:, r] + np.uint64(((r + 1) * _P) % 2**64)).view(np.int64)), "cid": b.column(0)})

    held = classes.count() * runs
    placed = cut(classes.select("cid", "samples").mapInArrow(roots, "key long, cid long"), held)
    tight, small, level = [], None, 0
    while True:
        # the members of each bucket, counted before they are moved; what is alone in its bucket goes
        sizes = cut(placed.groupBy("key").agg(F.count("*").alias("size"), F.min("cid").alias("least")).where("size > 1"), held)
        few = met(placed, sizes.where(F.col("size") <= leaf), ["key"], "size").select("key", "cid")
        small = few if small is None else small.unionByName(few)
        large = sizes.where(F.col("size") > leaf)
        held = large.agg(F.sum("size")).first()[0]
        if not held:
            break
        rows = cut(met(placed, large, ["key"], "size").select("key", "cid", "size", "least"), held)
        if level == LEVELS:
            # what four splits have left together is few, and compared as a whole
            tight.append(rows.select(F.col("cid").alias("a"), F.col("least").alias("b")))
            break
        spot = lambda j: runs + F.pmod(F.xxhash64("key", F.lit(level), F.lit(j)), F.lit(POOL))  # noqa: B023, E731
        child = F.explode(F.array(*[F.xxhash64("key", F.lit(j), F.substring(F.col("samples"), (spot(j) * 4 + 1).cast("int"), F.lit(4))) for j in range(SPLITS)]))
        split = rows.join(classes.select("cid", "samples"), "cid").select(F.col("key").alias("parent"), F.col("size").alias("parent_size"), "cid", child.alias("key"))
        split = cut(split, SPLITS * held)
        counts = split.groupBy("key", "parent", "parent_size").agg(F.count("*").alias("size"))
        alike = cut(counts.groupBy("parent", "parent_size").agg(F.max(F.col("size") / F.col("parent_size")).alias("share"), (F.sum("size")).alias("_rows")).withColumnRenamed("parent", "key"), held)
        dense = cut(_like_representatives(rows.select("key", "cid", "size"), alike.where("share >= 0.5").select("key"), classes, coordinates, floor), held)
        near = dense.where("ball is not null").select(F.col("cid").alias("a"), F.col("ball").alias("b"))
        tight.append(near)
        # what is linked to a representative is done here; all others go on in their parts
        loose = alike.where("share < 0.5").select(F.col("key").alias("parent"), "_rows")
        rest = split.withColumnRenamed("key", "child").join(dense.where("ball is null").select(F.col("key").alias("parent"), "cid"), ["parent", "cid"], "left_semi").select(F.col("child").alias("key"), "cid")
        placed = cut(met(split, loose, ["parent"], "_rows").select("key", "cid").unionByName(rest), SPLITS * held)
        level, held = level + 1, SPLITS * held
    every = small.join(classes.select("cid", "samples"), "cid").select("key", "cid", "samples")

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0
        for g in grouped(batches, "key"):
            if g.num_rows < 2:
                continue
            cid = g.column(1).to_numpy(zero_copy_only=False)
            s = np.frombuffer(b"".join(g.column(2).to_pylist()), np.uint32).reshape(len(cid), coordinates)
            order = np.argsort(cid, kind="stable")
            cid, s = cid[order], s[order]
            if len(cid) == 2:
                label = np.array([0, 0 if (s[0] == s[1]).sum() >= floor else 1])
            else:
                label = labels_of(np.stack([(s == x).sum(1) >= floor for x in s]))
            linked = label != np.arange(len(cid))
            if linked.any():
                found.append(np.stack([cid[linked], cid[label[linked]]]))
                held += int(linked.sum())
            if held > 20_000:
                a, b = np.unique(np.concatenate(found, 1), axis=1)
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})
                found, held = [], 0
        if found:
            a, b = np.unique(np.concatenate(found, 1), axis=1)
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    links = every.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    for t in tight:
        links = links.unionByName(t)
    return links


def _similar(sets: list[np.ndarray], to: np.ndarray) -> np.ndarray:
    """The similarity of each set (sorted distinct values) to one."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(to, flat), len(to) - 1)
    both = np.add.reduceat((to[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
    return both / (size + len(to) - both)


def covered(full: DataFrame, threshold: float, leaf: int) -> DataFrame:
    """(cid, root, ball) of the nodes of large groups that are within half a link's distance of a representative, `ball`.
    A node belongs to the first round's closest one. full: cid, root, nodes, grams_set (sorted)."""
    close = 1 - (1 - threshold) / 2
    left = full.select("cid", "root", "nodes", "grams_set")
    out = None
    for k in range(ROUNDS):
        pick = left.groupBy("root").agg(F.max("nodes").alias("nodes"), F.array_distinct(F.array(*[F.min_by("cid", F.xxhash64("cid", F.lit(k), F.lit(j))) for j in range(REPRESENTATIVES)])).alias("balls"))
        chosen = pick.select("root", F.ceil(F.col("nodes") * 2 / leaf).cast("long").alias("parts"), F.explode("balls").alias("cid"))
        sets = left.select("cid", "grams_set").join(chosen, "cid").select("root", "cid", "grams_set", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("chosen"))
        rows = left.select("root", "cid", "grams_set", F.pmod(F.xxhash64("cid", F.lit(11)), F.ceil(F.col("nodes") * 2 / leaf).cast("long")).alias("part"), F.lit(False).alias("chosen"))
        dealt = sets.unionByName(rows).withColumn("group", F.xxhash64("root", "part")).drop("part")

        @lean
        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in grouped(batches, "group"):
                root, cid, chosen = (g.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
                every = [np.frombuffer(x, np.uint64) for x in g.column(2).to_pylist()]
                mine = np.flatnonzero(~chosen)
                if not len(mine) or len(mine) == len(cid):
                    continue
                best, ball = np.zeros(len(mine)), np.zeros(len(mine), np.int64)
                for c in sorted(np.flatnonzero(chosen), key=lambda c: cid[c]):
                    like = np.where(root[mine] == root[c], _similar([every[m] for m in mine], every[c]), 0.0)  # noqa: B023
                    ball = np.where(like > best, cid[c], ball)
                    best = np.maximum(best, like)
                took = best >= close + 1e-9
                yield pa.record_batch({"cid": pa.array(cid[mine][took]), "root": pa.array(root[mine][took]), "ball": pa.array(ball[took])})

        got = cut(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(near, "cid long, root long, ball long"))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select("cid"), "cid", "left_anti")
    return out


def exact_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, n: int, threshold: float, leaf: int = LEAF) -> DataFrame:
    """For each node with links: how many documents it is linked to outside its own copies, and a node of its connected
    part that comparisons link it to (`low`). groups: (cid, root) of what may be linked."""
    members = groups.join(classes.select("cid", "least_id", "k1", "k2", "n", "copies"), "cid")
    about = members.groupBy("root").agg(F.count("*").alias("nodes"), F.sum(F.col("n").cast("long")).alias("grams"))
    about = cut(about)
    nodes = about.agg(F.sum("nodes")).first()[0] or 0
    members = cut(met(members, about, ["root"], "nodes"), nodes)

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, size, _, begin, keys in _ids_and_sets(batches, n):
            yield pa.record_batch({"least_id": ids, "k1": pa.array(keys[0]), "k2": pa.array(keys[1]), "grams_set": pa.array([np.sort(h[begin[i] : begin[i + 1]]).tobytes() for i in range(len(size))], pa.binary())})

    texts = semi_by_id(docs.select(F.col("doc_id").cast("long").alias("least_id"), "text"), members.select("least_id").distinct(), "least_id")
    # rows that share an id and a set of n-grams stand for one node
    found = texts.mapInArrow(sets, "least_id long, k1 long, k2 long, grams_set binary").join(members, ["least_id", "k1", "k2"])
    full = found.dropDuplicates(["cid"])
    full = staged(full.select("cid", "root", "copies", "nodes", "grams", "grams_set"), "ngram-sets")
    wide = F.greatest(F.ceil(F.col("nodes") * 2 / leaf), F.ceil(F.col("grams") / 2_000_000)).cast("long")
    large = F.col("nodes") > leaf
    whole = full.where(~large).withColumn("parts", wide)
    spread = full.where(large)
    counted = None
    if spread.isEmpty():
        dealt = _paired_blocks(whole, "root", "cid", F.col("parts"))
    else:
        balls = covered(spread, threshold, leaf)
        known = cut(spread.select("cid", "root", "copies", "nodes", "grams").join(balls.select("cid", "ball"), "cid", "left"))
        share = known.groupBy("root", "ball").agg(F.count("*").alias("_rows"), F.sum("copies").alias("held"), F.max("grams").alias("grams"), F.max("nodes").alias("nodes"))
        # blocks are numbered through a group, each ball's one after another, those of what is left last
        share = share.withColumn("many", F.greatest(F.ceil(F.col("_rows") * 2 / leaf), F.ceil(F.col("grams") * F.col("_rows") / F.col("nodes") / 2_000_000)).cast("long"))
        order = Window.partitionBy("root").orderBy(F.col("ball").isNull(), "ball")
        share = share.withColumn("from", F.coalesce(F.sum("many").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("many").over(Window.partitionBy("root")))
        share = cut(share.withColumn("b", F.xxhash64("root", F.coalesce(F.col("ball").cast("string"), F.lit("rest")))).select("b", "_rows", "held", "many", "from", "all"))
        known = known.withColumn("b", F.xxhash64("root", F.coalesce(F.col("ball").cast("string"), F.lit("rest"))))
        placed = cut(met(known, share, ["b"], "_rows").select("cid", "root", "ball", "copies", "held", "many", "from", "all"))
        counted = placed.where("ball is not null and held > copies").select("cid", (F.col("held") - F.col("copies")).alias("links"), F.col("ball").alias("low"))
        before = F.when(F.col("from") > 0, F.sequence(F.lit(0).cast("long"), F.col("from") - 1)).otherwise(F.array().cast("array<bigint>"))
        behind = F.when(F.col("from") + F.col("many") < F.col("all"), F.sequence(F.col("from") + F.col("many"), F.col("all") - 1)).otherwise(F.array().cast("array<bigint>"))
        own = F.col("from") + F.pmod(F.xxhash64("cid", F.lit(7)), F.col("many"))
        other = F.when(F.col("ball").isNull(), F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).otherwise(F.concat(before, behind))
        met_by = placed.where(F.size(other) > 0).withColumn("block", own).withColumn("_other", F.explode(other))
        met_by = met_by.select("cid", F.xxhash64("root", F.least("block", "_other"), F.greatest("block", "_other")).alias("group"), (F.col("block") == F.col("_other")).alias("same"), "block")
        rest = spread.select("cid", "copies", "grams_set").join(met_by, "cid")
        dealt = _paired_blocks(whole, "root", "cid", F.col("parts")).select("cid", "copies", "grams_set", "group", "same", "block").unionByName(rest)
    dealt = dealt.select("group", "cid", "copies", "block", "grams_set", "same")

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, "group"):
            if g.num_rows < 2:
                continue
            cid, at = np.unique(g.column(1).to_numpy(zero_copy_only=False), return_index=True)
            copies, block = (g.column(k).to_numpy(zero_copy_only=False)[at] for k in (2, 3))
            every = [np.frombuffer(x, np.uint64) for x in g.column(4).take(pa.array(at)).to_pylist()]
            size = np.array([len(x) for x in every])
            grams, which, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(cid)), size)
            shared = count[which] > 1
            column = (np.cumsum(count > 1) - 1)[which[shared]]
            owner = owner[shared]
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            both = np.zeros((len(cid), len(cid)), np.float32)
            width = 8192
            for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                a, b = np.searchsorted(column, [lo, lo + width])
                m = np.zeros((len(cid), width), np.float32)
                m[owner[a:b], column[a:b] - lo] = 1
                both += m @ m.T
            near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
            np.fill_diagonal(near, False)
            # pairs within a block are counted in its own group, whatever else a group of two blocks holds
            counted = near if g.column(5)[0].as_py() else near & (block[:, None] != block[None, :])
            label = labels_of(near)
            links = counted.astype(np.int64) @ copies
            some = near.any(1)
            if some.any():
                yield pa.record_batch({"cid": pa.array(cid[some]), "links": pa.array(links[some]), "low": pa.array(cid[label[some]])})

    out = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "cid long, links long, low long")
    links = cut(out if counted is None else out.unionByName(counted))
    discarded(full)
    return links


def _classified(docs: DataFrame, threshold: float, words: int, recall: float, leaf: int) -> DataFrame:
    """doc_id, text_hash, class_id and n_links of every row."""
    runs = runs_for(recall, threshold)
    sketch = staged(sketches(docs, words, runs + POOL), "sketches")
    # a node is a set of n-grams, so one id with different texts is as many nodes
    classes = (sketch.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least_id"), F.count("doc_id").alias("copies"), F.count("*").alias("_rows"), F.first("samples").alias("samples"))
               .where("least_id is not null").withColumn("cid", F.xxhash64("k1", "k2", "n")))
    classes = staged(classes, "classes")
    groups = linked_groups(candidate_links(classes, runs, threshold, leaf)).withColumnRenamed("node", "cid")
    links = exact_links(docs, classes, groups, words, threshold, leaf)
    roots = cut(linked_groups(links.select(F.col("cid").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "cid").join(classes.select("cid", "least_id"), "cid"))
    least = cut(roots.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count("*").alias("_rows")))
    named = met(roots.select("cid", "root"), least, ["root"], "_rows").select("cid", "class_id")
    counted = links.groupBy("cid").agg(F.sum("links").alias("links")).join(named, "cid", "left")
    known = staged(classes.select("k1", "k2", "cid", "least_id", "copies", "_rows").join(counted, "cid", "left"), "counted-classes")
    discarded(classes)
    # texts without words have no set and meet nothing
    wordless = sketch.where("n = 0 or doc_id is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    rows = met(sketch.where("n > 0 and doc_id is not null").select("doc_id", "text_hash", "k1", "k2"), known, ["k1", "k2"], "_rows")
    linked = rows.select("doc_id", "text_hash", F.coalesce("class_id", "least_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return linked.unionByName(wordless)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """doc_id, class_id (the smallest id of those linked to it, directly or over others) and n_links."""
    return _classified(docs, threshold, words, recall, leaf).drop("text_hash")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """docs without the documents that have a smaller id in their class; all columns stay."""
    names = docs.columns
    of, key = (next(x for k in range(len(names) + 1) if (x := f"{want}{k}") not in {n.lower() for n in names}) for want in ("away_", "text_"))
    away = cut(_classified(docs, threshold, words, recall, leaf).where("class_id <> doc_id").select(F.col("doc_id").alias(of), F.col("text_hash").alias(key)).distinct())
    few = away.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = (F.col("doc_id").cast("long") == F.col(of)) & (_text_hash() == F.col(key))
    return docs.join(F.broadcast(away) if few else away.hint("shuffle_merge"), same, "left_anti")
