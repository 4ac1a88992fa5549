"""Repeated passages by sparse suffix arrays.

Of all suffixes (a document from one word on) only those at content-selected places are kept: in every run of
PASSAGE - PREFIX + 1 neighbouring places, the one whose first PREFIX words hash least. So two equal passages of PASSAGE
words keep suffixes at the same place of each. The suffixes are sorted by their words over all partitions (four words one
by one, each as its hash, then the rest of the first PREFIX as one) and neighbours compared: only those that begin as a
neighbour does are looked at again. These are sorted once more, now with the words around them, and suffixes that begin
alike are extended together, word by word to the left and to the right, until PASSAGE words agree; the earliest of those
that agree is the one kept. Overlapping repeats become one span.

A run of suffixes that begin alike is extended in the block of rows that holds it. A run that is longer than a block, or
may go on in the next range, is taken in pieces: of a piece's passages the first of equal ones are sorted by their own words
over all partitions, and neighbours compared; the others are repeats whatever is found there, and follow their first one to
the document that it is from. So a passage of a third of all documents is spread over ranges, as few rows a piece, and still
exact.

A passage is a repeat if an equal one begins earlier, in a document of smaller id or before it in the same document; the
earliest stays. Words are as everywhere here (cut at ASCII white space), compared as 32-bit hashes, PASSAGE in a row.
Null, empty and short texts have no repeats. Rows without doc_id are left alone. Rows with one id and one text are one
document; different texts of one id are different documents, in the order of a hash of their texts: only then are all
documents numbered by a sort of ids and hashes, without texts. Texts are taken whole, of any length. An empty table has no repeats. Columns other than doc_id and text (and n_chars in
``without_repeats``) only pass through there, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BROADCAST_ROWS, cut, discarded, lean, met, semi_by_id, staged
from .textarrays import mixed, ngram_hashes, powers, sliding, text_slices, _P, _P_INVERSE

PASSAGE, PREFIX, SORTED_WORDS = 50, 25, 4
#: Rows that are extended together; a run of suffixes that begin alike and fills more is spread instead.
BLOCK = 1 << 15
_ORDER = ("k1", "k2", "k3", "doc_id", "place")


def _sort_keys(words: np.ndarray, begins: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For the suffixes at `at`: their first four words in two numbers, and the hash of all that they begin with."""
    w = words >> np.uint64(32)
    two = lambda k: (w[at + k] << np.uint64(32) | w[at + k + 1]).view(np.int64)
    return [two(0), two(2), begins[at].view(np.int64)]


def suffixes(docs: DataFrame, passage: int, prefix: int) -> DataFrame:
    """Kept suffixes: sort keys k1 to k3, doc_id, place (the word they begin at)."""
    width = passage - prefix + 1

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_slices(b):
                words, owner = t.hashes(), t.owners()
                if len(words) < passage:
                    continue
                h = ngram_hashes(words, prefix) | np.uint64(1)
                least = np.where(owner[passage - 1 :] == owner[: len(words) - passage + 1], sliding(h, width, True), np.uint64(0))
                around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
                at = np.flatnonzero(sliding(around, width, False) == h)
                k1, k2, k3 = _sort_keys(words, h, at)
                yield pa.record_batch({"k1": pa.array(k1), "k2": pa.array(k2), "k3": pa.array(k3), "doc_id": b.column(0).take(pa.array(t.first + owner[at])), "place": pa.array((at - t.word_bounds[owner[at]]).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, "k1 long, k2 long, k3 long, doc_id long, place int")


def repeated_suffixes(kept: DataFrame) -> DataFrame:
    """doc_id and place of the suffixes that begin as a neighbour in sorted order does. At the ends of a sorted range,
    whose neighbours are elsewhere, all are passed on: extension decides."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for b in batches:
            if not b.num_rows:
                continue
            c = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if held is not None:
                c = [np.append(h, x) for h, x in zip(held[0], c, strict=True)]
            same = np.all([x[1:] == x[:-1] for x in c[:3]], 0)
            keep = np.append(same, False)
            keep[1:] |= same
            keep[0] |= first if held is None else held[1]
            first = False
            held = [x[-1:] for x in c], bool(keep[-1])
            yield pa.record_batch({"doc_id": pa.array(c[3][:-1][keep[:-1]]), "place": pa.array(c[4][:-1][keep[:-1]])})
        if held is not None:
            yield pa.record_batch({"doc_id": pa.array(held[0][3]), "place": pa.array(held[0][4])})

    return kept.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(run, "doc_id long, place int")


def with_words_around(texts: DataFrame, passage: int, prefix: int) -> DataFrame:
    """From doc_id, text and the places of its repeated suffixes: these with their sort keys, the words to the left and
    right as far as a passage reaches, 4 bytes each, and in `ways` one bit for each passage that this suffix stands for
    (from the one that reaches farthest to the left): those whose least it is."""
    reach = passage - prefix
    if reach > 62:
        raise ValueError("a passage has at most 62 words more than a prefix")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_slices(b):
                words = t.hashes()
                places = [np.unique(b.column(2)[t.first + i].values.to_numpy(zero_copy_only=False)) for i in range(t.n)]
                owner = np.repeat(np.arange(t.n), [len(p) for p in places])
                begin, end = t.word_bounds[owner], t.word_bounds[owner + 1]
                at = begin + np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
                good = at + prefix <= end
                owner, begin, end, at = (x[good] for x in (owner, begin, end, at))
                if not len(at):
                    continue
                h = ngram_hashes(words, prefix) | np.uint64(1)
                least = sliding(h, reach + 1, True)
                start = at[:, None] + np.arange(-reach, 1)
                fits = (start >= begin[:, None]) & (start + passage <= end[:, None])
                fits &= least[np.clip(start, 0, max(0, len(least) - 1))] == h[at][:, None] if len(least) else False
                ways = (fits.astype(np.int64) << np.arange(reach + 1)).sum(1)
                good = ways != 0
                owner, begin, at, ways = (x[good] for x in (owner, begin, at, ways))
                short = (words >> np.uint64(32)).astype(np.uint32)
                for lo in range(0, len(at), 8192):
                    a = at[lo : lo + 8192]
                    place = np.clip(a[:, None] + np.arange(-reach, passage), 0, len(words) - 1)
                    raw, width = short[place].tobytes(), 4 * (reach + passage)
                    k1, k2, k3 = _sort_keys(words, h, a)
                    o, part = owner[lo : lo + 8192], slice(lo, lo + 8192)
                    yield pa.record_batch({"k1": pa.array(k1), "k2": pa.array(k2), "k3": pa.array(k3), "doc_id": b.column(0).take(pa.array(t.first + o)), "place": pa.array((a - begin[part]).astype(np.int32)),
                                           "ways": pa.array(ways[part]), "words": pa.array([raw[k * width : (k + 1) * width] for k in range(len(a))], pa.binary())})

    return texts.select("doc_id", "text", "places").mapInArrow(run, "k1 long, k2 long, k3 long, doc_id long, place int, ways long, words binary")


class _Run:
    """Rows of suffixes in sorted order: which begin alike, and how the words around them agree."""

    def __init__(self, batch: pa.RecordBatch, passage: int, prefix: int):
        self.passage, self.reach = passage, passage - prefix
        key = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        self.doc, self.place, ways = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3, 6))
        fresh = np.append(True, np.any([x[1:] != x[:-1] for x in key], 0))
        # a row that is there again (its document is) counts once
        again = ~fresh & np.append(False, (self.doc[1:] == self.doc[:-1]) & (self.place[1:] == self.place[:-1]))
        self.alike = np.cumsum(fresh)
        self.words = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint32).reshape(len(self.doc), self.reach + passage)
        #: for each way to extend, from all to the left to all to the right: whether the document has these words
        self.there = ((ways[:, None] >> np.arange(self.reach + 1)) & 1).astype(bool) & ~again[:, None]
        sums = np.zeros((len(self.doc), self.words.shape[1] + 1), np.uint64)
        np.cumsum(self.words * powers(_P, self.words.shape[1]), 1, out=sums[:, 1:])
        self.sums = sums

    def passages(self, k: int) -> np.ndarray:
        """A hash of each row's passage that begins k words after the leftmost one."""
        return mixed((self.sums[:, k + self.passage] - self.sums[:, k]) * powers(_P_INVERSE, k + 1)[k])

    def repeats(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows whose passage k an earlier row has too, the first of those rows, and whether the last of those is of the
        same document."""
        rows = np.flatnonzero(self.there[:, k])
        key = mixed(self.passages(k)[rows] + self.alike[rows].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
        first = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        later = np.flatnonzero(~fresh)
        agree = (self.words[rows[later], k : k + self.passage] == self.words[first[later], k : k + self.passage]).all(1)
        later = later[agree]
        return rows[later], first[later], self.doc[rows[later]] == self.doc[rows[later - 1]]

    def extended(self) -> dict[str, np.ndarray]:
        """Repeats in documents: where they start, over how many following starts they go on, and the document they are
        from: the row's own if it has the words before, else the earliest."""
        n, ways = self.there.shape
        found, source = np.zeros((n, ways), bool), np.zeros((n, ways), np.int64)
        for k in range(ways):
            rows, first, own = self.repeats(k)
            found[rows, k] = True
            source[rows, k] = np.where(own, self.doc[rows], self.doc[first])
        goes_on = np.zeros((n, ways), bool)
        goes_on[:, 1:] = found[:, 1:] & found[:, :-1] & (source[:, 1:] == source[:, :-1])
        row, k = np.nonzero(found & ~goes_on)
        at = np.flatnonzero((found & ~goes_on)[found])
        return {"doc_id": self.doc[row], "start": self.place[row] - self.reach + k, "run": np.diff(np.append(at, int(found.sum()))), "source": source[row, k]}

    def spread(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """For rows that begin alike, a piece of a run: the passages to be sorted over all partitions, and those that
        follow one of these, `of` from `of_start` on, or repeat the document's own. The first and the last document may be
        in other pieces too, so all their passages are sorted."""
        n, ways = self.there.shape
        inner = (self.doc != self.doc[0]) & (self.doc != self.doc[-1])
        first, own = np.full((n, ways), -1), np.zeros((n, ways), bool)
        for k in range(ways):
            rows, of, same = self.repeats(k)
            at = inner[rows]
            first[rows[at], k], own[rows[at], k] = of[at], same[at]
        follows = first >= 0
        row, k = np.nonzero(self.there & ~follows)
        every = np.stack([self.passages(j) for j in range(ways)], 1)
        alone = {"hash": every[row, k].view(np.int64), "doc_id": self.doc[row], "start": self.place[row] - self.reach + k, "run": np.ones(len(row), np.int64)}
        goes_on = np.zeros((n, ways), bool)
        goes_on[:, 1:] = follows[:, 1:] & (own[:, 1:] == own[:, :-1]) & (np.where(own, -2, first)[:, 1:] == np.where(own, -2, first)[:, :-1])
        row, k = np.nonzero(follows & ~goes_on)
        at = np.flatnonzero((follows & ~goes_on)[follows])
        of, same = first[row, k], own[row, k]
        return alone, {"doc_id": self.doc[row], "start": self.place[row] - self.reach + k, "run": np.diff(np.append(at, int(follows.sum()))),
                       "source": pa.array(self.doc[row], mask=~same), "of": pa.array(self.doc[of], mask=same), "of_start": pa.array((self.place[of] - self.reach + k).astype(np.int32), mask=same)}


def _rows(c: dict) -> pa.RecordBatch:
    n = len(c["doc_id"])
    whole = lambda x, kind=pa.int64(): pa.nulls(n, kind) if x is None else pa.array(x, kind)
    return pa.record_batch({"hash": whole(c.get("hash")), "doc_id": whole(c["doc_id"]), "start": pa.array(c["start"].astype(np.int32)), "run": pa.array(c["run"].astype(np.int32)), "source": whole(c.get("source")), "of": whole(c.get("of")), "of_start": whole(c.get("of_start"), pa.int32())})


def extensions(around: DataFrame, passage: int, prefix: int, block: int = BLOCK) -> DataFrame:
    """Suffixes in sorted order, those that begin alike extended together: repeats (doc_id, start, run, source). Of those
    whose run a block does not hold, the different passages of each piece with a hash, and all others with the passage (of,
    of_start) that they repeat."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, spreading = 0, True  # the first run may have begun in the range before

        def keys(b: pa.RecordBatch) -> list[np.ndarray]:
            return [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]

        def closed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, spreading
            whole = pa.concat_batches(held)
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys(whole)], 0)) + 1
            if spreading:
                upto = int(cuts[0]) if len(cuts) else whole.num_rows
                yield from map(_rows, _Run(whole.slice(0, upto), passage, prefix).spread())
                spreading = not len(cuts)
                whole, cuts = whole.slice(upto), cuts[1:] - upto
            end = int(cuts[-1]) if len(cuts) else 0
            if end:
                yield _rows(_Run(whole.slice(0, end), passage, prefix).extended())
            rest = whole.slice(end)
            if rest.num_rows and (last or rest.num_rows >= block):
                yield from map(_rows, _Run(rest, passage, prefix).spread())
                spreading, rest = True, rest.slice(rest.num_rows)
            held, size = [rest] if rest.num_rows else [], rest.num_rows

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
                if size >= block:
                    yield from closed(False)
        if held:
            yield from closed(True)

    columns = (*_ORDER, "ways", "words")
    return around.select(*columns).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(run, "hash long, doc_id long, start int, run int, source long, of long, of_start int")


def _later_ones(found: DataFrame) -> DataFrame:
    """Of passages that are equal, all but the earliest, with the document they are from (`source`: the row's own if it has
    the one before) and the earliest one's (`origin`). Rows are sorted by hash and place over all partitions; a range that
    begins within a run of equal ones learns where the run began from the ranges before."""
    ordered = found.repartitionByRange("hash", "doc_id", "start").sortWithinPartitions("hash", "doc_id", "start").select("hash", "doc_id", "start")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, origin, head = TaskContext.get().partitionId(), None, None, True
        for b in batches:
            key, doc, start = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            # a passage may be reached from two of its suffixes that hash alike, and counts once
            old = last or (None, None, None)
            other = np.append(not len(key) or (key[0], doc[0], start[0]) != old, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))[: len(key)]
            key, doc, start = key[other], doc[other], start[other]
            if not len(key):
                continue
            fresh = np.append(key[0] != old[0], key[1:] != key[:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
            source = np.where(first >= 0, doc[np.maximum(first, 0)], -1 if origin is None else origin)
            own = ~fresh & np.append(doc[0] == old[1], doc[1:] == doc[:-1])
            opening = np.zeros(len(key), bool)
            if head:
                cuts = np.flatnonzero(fresh)
                stop = int(cuts[1]) if last is None and len(cuts) > 1 else int(cuts[0]) if last is not None and len(cuts) else len(key)
                opening[:stop], head = True, stop == len(key)
            last, origin = (key[-1], doc[-1], start[-1]), source[-1]
            keep = ~fresh | opening
            # of the opening run, whether even its first row is a repeat is not known here: it carries its hash
            yield pa.record_batch({"part": pa.array(np.full(int(keep.sum()), part, np.int32)), "doc_id": pa.array(doc[keep]), "start": pa.array(start[keep]), "source": pa.array(source[keep]), "hash": pa.array(key[keep], mask=~opening[keep]), "is_first": pa.array(fresh[keep]), "own": pa.array(own[keep])})
        if last is not None:
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "doc_id": pa.array([None], pa.int64()), "start": pa.array([None], pa.int32()), "source": pa.array([origin], pa.int64()), "hash": pa.array([last[0]], pa.int64()), "is_first": pa.array([False]), "own": pa.array([False])})

    rows = staged(ordered.mapInArrow(run, "part int, doc_id long, start int, source long, hash long, is_first boolean, own boolean"), "neighbours")
    # one row for each sorted range, as many as there are partitions: the hash it ends with, and where that run began
    ends = sorted(rows.where("doc_id is null").select("part", "hash", "source").collect())
    began: dict[int, int] = {}
    closing: list[int | None] = []  # for each range, what the one before it that has rows ends with
    source: list[int | None] = []
    for e in ends:
        fill = e["part"] + 1 - len(closing)
        closing += closing[-1:] * fill if closing else [None] * fill
        source += source[-1:] * fill if source else [None] * fill
        began.setdefault(e["hash"], e["source"])
        closing.append(e["hash"])
        source.append(began[e["hash"]])
    closing, source = closing or [None], source or [None]
    body = rows.where("doc_id is not null")
    of_range = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("part"))
    opened = (body.where("hash is not null").withColumn("before", F.coalesce(of_range(closing) == F.col("hash"), F.lit(False)))
              .where("before or not is_first").select("doc_id", "start", F.when(F.col("before"), of_range(source)).otherwise(F.col("source")).alias("origin"), "own"))
    later = body.where("hash is null").select("doc_id", "start", F.col("source").alias("origin"), "own").unionByName(opened)
    return later.select("doc_id", "start", F.when(F.col("own"), F.col("doc_id")).otherwise(F.col("origin")).alias("source"), "origin")


def _followed(follow: DataFrame, later: DataFrame) -> DataFrame:
    """Repeats (doc_id, start, run, source) of what follows other passages: a row for each document that these are from,
    which is their own if nothing equal is earlier."""
    key = ["of", "of_start", "run"]
    each = follow.groupBy(*key).agg(F.count("*").alias("_rows")).withColumn("at", F.explode(F.expr("sequence(of_start, of_start + run - 1)")))
    first = each.join(later.select(F.col("doc_id").alias("of"), F.col("start").alias("at"), "origin"), ["of", "at"], "left")
    first = cut(first.groupBy(*key).agg(F.max("_rows").alias("_rows"), F.collect_set(F.coalesce("origin", "of")).alias("origins")))
    return met(follow, first, key, "_rows").select("doc_id", "start", "run", F.explode("origins").alias("source"))


def _numbers(docs: DataFrame) -> DataFrame | None:
    """doc_id, text_hash and number of every document, in the order of both, if an id has different texts; else None."""
    each = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    if each.groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").isEmpty():
        return None
    w = Window.partitionBy("part").orderBy("doc_id", "text_hash")
    ranged = staged(each.distinct().repartitionByRange("doc_id", "text_hash").withColumn("part", F.spark_partition_id()), "documents-in-order")
    # one row for each range: how many documents are before it
    before, total = {}, 0
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        before[part], total = total, total + n
    at = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    return staged(ranged.select("doc_id", "text_hash", (F.element_at(at, F.col("part")) + F.row_number().over(w)).cast("long").alias("number")), "numbers")


def _with_number(docs: DataFrame, numbers: DataFrame | None, name: str) -> DataFrame:
    """docs with each document's number: its id, unless documents are numbered."""
    if numbers is None:
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    n = numbers.select(F.col("doc_id").alias(f"{name}_id"), F.col("text_hash").alias(f"{name}_hash"), F.col("number").alias(name))
    same = (docs["doc_id"].cast("long") == n[f"{name}_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == n[f"{name}_hash"])
    return docs.join(n, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], name)


def repeated_spans(docs: DataFrame, passage: int = PASSAGE, prefix: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """doc_id, start and end (words), n_words and sources (documents in which the repeated passages occur first)."""
    docs = docs.select("doc_id", "text")
    numbers = _numbers(docs)
    if numbers is None:
        return _spans(docs, passage, prefix, block)
    spans = staged(_spans(_with_number(docs, numbers, "number").select(F.col("number").alias("doc_id"), "text"), passage, prefix, block), "numbered-spans")
    ids = numbers.select("number", F.col("doc_id").alias("id"))
    sources = spans.select("doc_id", "start", F.explode("sources").alias("number")).join(ids, "number").groupBy("doc_id", "start").agg(F.sort_array(F.collect_set("id")).alias("sources"))
    return spans.drop("sources").join(sources, ["doc_id", "start"]).withColumnRenamed("doc_id", "number").join(ids, "number").select(F.col("id").alias("doc_id"), "start", "end", "n_words", "sources")


def _spans(docs: DataFrame, passage: int, prefix: int, block: int) -> DataFrame:
    """The same where every id has one text."""
    if not SORTED_WORDS <= prefix <= passage:
        raise ValueError("a prefix has at least four words and no more than a passage")
    kept = staged(suffixes(docs, passage, prefix), "suffixes")
    places = staged(repeated_suffixes(kept).groupBy("doc_id").agg(F.collect_list("place").alias("places")), "repeated-suffixes")
    discarded(kept)
    texts = semi_by_id(docs.select(F.col("doc_id").cast("long"), "text"), places.select("doc_id"), "doc_id")
    around = staged(with_words_around(texts.join(places.hint("shuffle_merge"), "doc_id"), passage, prefix), "words-around")
    found = staged(extensions(around, passage, prefix, block), "extensions")
    discarded(places, around)
    later = _later_ones(found.where("hash is not null"))
    repeats = found.where("source is not null").select("doc_id", "start", "run", "source").unionByName(later.select("doc_id", "start", F.lit(1).alias("run"), "source"))
    follow = found.where("of is not null").select("doc_id", "start", "run", "of", "of_start")
    if not follow.isEmpty():
        repeats = repeats.unionByName(_followed(follow, later))
    flagged = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("start", "run", "source")).alias("found"))

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, found in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parts = found.values
                start, runs, source = (parts.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                order = np.argsort(start, kind="stable")
                start, source = start[order], source[order]
                end = np.maximum.accumulate(start + runs[order] - 1 + passage)
                cuts = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                for lo, hi in zip(cuts, np.append(cuts[1:], len(start)), strict=True):
                    rows.append((doc, int(start[lo]), int(end[hi - 1]), int(end[hi - 1] - start[lo]), np.unique(source[lo:hi]).tolist()))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.record_batch({"doc_id": pa.array(c[0], pa.int64()), "start": pa.array(c[1], pa.int32()), "end": pa.array(c[2], pa.int32()), "n_words": pa.array(c[3], pa.int32()), "sources": pa.array(c[4], pa.list_(pa.int64()))})

    return flagged.mapInArrow(merge, "doc_id long, start int, end int, n_words int, sources array<long>")


def without_repeats(docs: DataFrame, passage: int = PASSAGE, prefix: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """docs with their repeated spans cut out of text (and n_chars set anew, if there); documents of which no word is
    left go. Documents without repeats stay as they are. Columns may have any names."""
    names = docs.columns
    of, at, number = (next(x for k in range(len(names) + 1) if (x := f"{want}{k}") not in {n.lower() for n in names}) for want in ("spans_of_", "spans_", "number_"))
    numbers = _numbers(docs.select("doc_id", "text"))
    docs = _with_number(docs, numbers, number)
    found = _spans(docs.select(F.col(number).alias("doc_id"), "text"), passage, prefix, block)
    spans = staged(found.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("start", "end")).alias(at)), "spans")
    # by broadcast if all lists together are small: 8 bytes a span, and as much again for each list
    size = spans.agg(F.sum(F.size(at) + 4)).first()[0] or 0
    few = size <= BROADCAST_ROWS
    joined = docs.join(F.broadcast(spans) if few else spans.hint("shuffle_merge"), F.col(number) == F.col(of), "left").select(*[F.col(f"`{n}`") for n in names], at)
    schema = docs.select(*[F.col(f"`{n}`") for n in names]).schema

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(names.index("text"))
            spans_at = b.column(len(names))
            if spans_at.null_count == len(spans_at):
                yield b.select(names)
                continue
            texts, keep = column.to_pylist(), np.ones(b.num_rows, bool)
            for t in text_slices(b):
                for i in range(t.n):
                    spans = spans_at[t.first + i].as_py()
                    if not spans:
                        continue
                    raw = t.data[t.bounds[i] : t.bounds[i + 1]]
                    starts = t.starts[t.word_bounds[i] : t.word_bounds[i + 1]] - t.bounds[i]
                    stay = np.ones(len(raw), bool)
                    for s in spans:
                        stay[starts[s["start"]] : starts[s["end"]] if s["end"] < len(starts) else len(raw)] = False
                    texts[t.first + i] = raw[stay].tobytes().decode()
                    keep[t.first + i] = bool(stay[starts].any())
            arrays = {n: b.column(k) for k, n in enumerate(names)} | {"text": pa.array(texts, column.type)}
            if "n_chars" in arrays:
                old = b.column(names.index("n_chars"))
                arrays["n_chars"] = pa.array([o if s is None else len(t) for o, s, t in zip(old.to_pylist(), spans_at.to_pylist(), texts, strict=True)], old.type)
            yield pa.record_batch(arrays).filter(pa.array(keep))

    return joined.mapInArrow(run, schema)
