"""A kept inverted index: postings in blocks under a folder, added to and removed from in segments, searched without reading
the texts again.

A segment is a part of each table, visible once its totals are written. Documents are dealt to windows (some WINDOW of them,
by a hash of their keys), and a window's documents lie side by side in ``forward``, with each document's terms, what they
weigh and their places. ``blocks`` is made from it as it lies, without dealing postings one by one: a row for each term and
some thousand documents has the keys, weights, lengths and places, and of each window where its postings end, the greatest
weight and the least length; in folders by a hash of the term and sorted by term. ``removed`` has the keys whose postings in
earlier segments no longer count, ``frequencies`` and ``totals`` what the segment changes in document frequencies, documents
and words: positive for what comes, negative for what goes, so that the sums over segments are exact at any version.
``compact`` writes all live documents as one base segment that hides earlier ones.

Totals carry the fingerprint of the analysis (fields, weights, how words are made, and what a probe sentence becomes). An
index is only opened by the analysis that made it.

A search reads the folders of its questions' terms alone. A block bounds the score of its term by its greatest f and least
length; the bounds of a question's terms add up by window, since all terms share the windows. The windows of largest bounds
are scored first; their k-th best score is a floor, and of the others only those are read whose bound reaches it. No document
among the k best is in a window below the floor, so the answer is exact. Blocks are dealt by window, whole and once, not once
a question: what a window's questions score there is added up where its blocks and its removed keys meet.

Rows without a key are not indexed; of rows with one key any one is. Null texts have no words and count as documents.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .lexical import plain_words, question_terms, top
from .staging import bounded, small_side, staged

#: Least documents of a window (of many documents, about as many as there are windows), folders of terms, and how many windows of a question are scored before there is a floor.
WINDOW, FOLDERS, FIRST = 64, 32, 4
#: Documents that one task analyses or scores, about, and rows that are counted at once.
TASK_DOCUMENTS, ROWS = 4000, 8192
#: Places of a field's words begin at its number times this.
FIELD = 1 << 24
_PROBE = "Re-indexing the user's 3 reports in-process, v2.1"


@dataclass(frozen=True)
class Analysis:
    """How texts become terms. phrases: a question's token is the phrase of its parts, and postings keep places; else
    tokens are terms as they are. stems: parts are compared by their stems."""

    fields: dict[str, float] = field(default_factory=lambda: {"text": 1.0})
    phrases: bool = False
    stems: bool = False

    def words(self, text: Column) -> Column:
        made = plain_words(text) if self.phrases else T.tokens(text)
        return T.stemmed(made) if self.stems else made

    def fingerprint(self, spark: SparkSession) -> str:
        probe = spark.range(1).select(self.words(F.lit(_PROBE)).alias("w")).first()["w"]
        return hashlib.sha256(json.dumps([dict(self.fields), self.phrases, self.stems, probe]).encode()).hexdigest()[:16]


def _folder_of(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _window_of(key: str, windows) -> Column:
    return F.pmod(F.xxhash64(key), windows).cast("int")


def _windows_of(documents: int) -> int:
    return max(1, -(-documents // max(WINDOW, math.isqrt(documents))))


def _groups(*codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the codes (the last one varies fastest), and where its groups begin."""
    order = np.lexsort(codes[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in codes:
        new[1:] |= np.diff(c[order]) != 0
    return order, np.flatnonzero(new)


def _lists(values: pa.Array, begin: np.ndarray) -> pa.Array:
    """Lists of values that begin at some places and end where the next one begins."""
    return pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)).astype(np.int32)), values)


def _owners(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each element of a column of lists its row, and its place there."""
    size = np.diff(column.offsets.to_numpy())
    owner = np.repeat(np.arange(len(column)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)


def _counts(weights: list[float], places: bool):
    """Rows of key, w and each field's words become rows of key, w, length, terms, f and places (or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                fields = b.columns[2:]
                each = [_owners(c) for c in fields]
                owner = np.concatenate([o for o, _ in each])
                coded = pa.concat_arrays([c.flatten().cast(pa.string()) for c in fields]).dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                # fields and places ascend within a group, since the order is stable
                order, begin = _groups(owner, code)
                weight = np.concatenate([np.full(len(o), w) for (o, _), w in zip(each, weights, strict=True)])[order]
                first = np.searchsorted(owner[order][begin], np.arange(b.num_rows))
                where = pa.nulls(b.num_rows, pa.list_(pa.list_(pa.int32())))
                if places:
                    every = np.concatenate([at + k * FIELD for k, (_, at) in enumerate(each)])[order].astype(np.int32)
                    where = _lists(_lists(pa.array(every), begin), first)
                f = np.add.reduceat(weight, begin) if len(begin) else weight
                yield pa.record_batch({
                    "key": b.column(0), "w": b.column(1), "length": pa.array(np.bincount(owner, minlength=b.num_rows).astype(np.int32)),
                    "terms": _lists(coded.dictionary.take(pa.array(code[order][begin])), first), "f": _lists(pa.array(f), first), "places": where})

    return run


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of forward become blocks."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            b = whole.slice(lo, ROWS)
            keys, w, length, terms, f, places = b.columns
            owner, _ = _owners(terms)
            if not len(owner):
                continue
            coded = terms.flatten().cast(pa.string()).dictionary_encode()
            code, window = coded.indices.to_numpy(zero_copy_only=False), w.to_numpy()[owner]
            order, begin = _groups(code, window)
            at, end = pa.array(order), np.append(begin[1:], len(order))
            weight, size, term = f.flatten().to_numpy()[order], length.to_numpy()[owner][order], code[order][begin]
            # of its windows those where a term begins, and where each window ends among the term's postings
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            ends = end - np.repeat(begin[first], np.diff(np.append(first, len(begin))))
            each = lambda values: _lists(pa.array(values), first)
            every = lambda values: _lists(values, begin[first])
            yield pa.record_batch({
                "term": coded.dictionary.take(pa.array(term[first])), "ws": each(window[order][begin].astype(np.int32)), "most": each(np.maximum.reduceat(weight, begin)),
                "least": each(np.minimum.reduceat(size, begin)), "ends": each(ends.astype(np.int32)), "keys": every(keys.take(pa.array(owner[order]))),
                "f": every(pa.array(weight)), "lengths": every(pa.array(size)), "places": every(places.flatten().take(at)) if places.null_count < len(places) else pa.nulls(len(first), places.type)})


_BLOCK = "term string, ws array<int>, most array<double>, least array<int>, ends array<int>, keys array<{0}>, f array<double>, lengths array<int>, places array<array<int>>"
_FORWARD = "key {0}, w int, length int, terms array<string>, f array<double>, places array<array<int>>"


class Postings:
    def __init__(self, spark: SparkSession, folder: str, analysis: Analysis | None = None):
        self.spark, self.folder, self.analysis = spark, folder.rstrip("/"), analysis or Analysis()
        self.mark = self.analysis.fingerprint(spark)
        self._known: dict[int, dict] = {}
        if {f["fingerprint"] for f in self._facts().values()} - {self.mark}:
            raise ValueError("the index was made by another analysis")

    def _path(self, segment: int, name: str) -> str:
        return f"{self.folder}/{name}/segment={segment:08d}"

    def _facts(self) -> dict[int, dict]:
        """What each segment's totals say, one row a segment; totals that were read once are not read again."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        done = lambda n: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals/{n}/_SUCCESS"))
        new = [n for x in names if x.startswith("segment=") and (n := int(x[8:])) not in self._known and done(x)]
        if new:
            for r in self._tables("totals", new, "").collect():
                self._known[r["segment"]] = r.asDict()
        return dict(sorted(self._known.items()))

    def segments(self) -> list[int]:
        """The segments that count: the last base and all after it."""
        facts = self._facts()
        last = max((n for n, f in facts.items() if f["base"]), default=0)
        return [n for n in facts if n >= last]

    @property
    def version(self) -> int:
        return max(self._facts(), default=0)

    def _tables(self, name: str, segments: list[int], key: str) -> DataFrame:
        """One scan of a table over segments, whose number is a column."""
        schema = {
            "blocks": f"{_BLOCK.format(key)}, segment int, folder int", "forward": f"{_FORWARD.format(key)}, segment int", "removed": f"key {key}, segment int",
            "frequencies": "term string, df long, segment int, folder int",
            "totals": "documents long, words long, fingerprint string, base boolean, key_type string, windows int, segment int",
        }[name]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*[self._path(n, name) for n in segments])

    def _every(self, name: str) -> DataFrame:
        segments = self.segments()
        if not segments:
            raise ValueError("there is no index")
        return self._tables(name, segments, self._known[segments[-1]]["key_type"])

    # writing

    def _tasks(self, documents: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-documents // TASK_DOCUMENTS))

    def _write(self, come: DataFrame | None, documents: int, gone: DataFrame | None, base: bool, key: str) -> int:
        """come: rows of forward, by window, of so many documents; gone: staged keys that are no longer there."""
        n = self.version + 1
        come = self.spark.createDataFrame([], _FORWARD.format(key)) if come is None else come
        come.write.mode("overwrite").option("compression", "zstd").parquet(self._path(n, "forward"))
        added = self._tables("forward", [n], key)
        blocks = added.select("key", "w", "length", "terms", "f", "places").mapInArrow(_blocked, _BLOCK.format(key)).withColumn("folder", _folder_of("term"))
        # a folder's blocks are sorted by as many tasks as its documents need
        parts = -(-documents // (FOLDERS * TASK_DOCUMENTS)) or 1
        blocks = blocks.repartition(FOLDERS * parts, "folder", F.pmod(F.get("ws", F.lit(0)), F.lit(parts)))
        blocks.sortWithinPartitions("folder", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(self._path(n, "blocks"))
        changes = self._tables("blocks", [n], key).groupBy("term").agg(F.sum(F.size("keys")).alias("df"))
        amount = lambda df, sign: df.agg((sign * F.count("*")).alias("documents"), (sign * F.coalesce(F.sum("length"), F.lit(0))).cast("long").alias("words"))
        totals = amount(added, 1)
        if gone is not None:
            lost = staged(self.forward().select("key", "length", "terms").join(small_side(gone), "key", "left_semi"), "lost")
            changes = changes.unionByName(lost.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")))
            totals = totals.unionByName(amount(lost, -1))
        (gone if gone is not None else added.select("key").limit(0)).write.mode("overwrite").parquet(self._path(n, "removed"))
        frequencies = changes.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("folder", _folder_of("term"))
        frequencies.repartition("folder").sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(self._path(n, "frequencies"))
        whole = totals.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words"))
        whole.withColumns({"fingerprint": F.lit(self.mark), "base": F.lit(base), "key_type": F.lit(key), "windows": F.lit(_windows_of(documents))}).write.mode("overwrite").parquet(self._path(n, "totals"))
        return n

    def put(self, docs: DataFrame, key: str) -> int:
        """Indexes documents; those whose key is known are replaced. Returns the segment's number, the new version."""
        fields = self.analysis.fields
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(fields)])
        keys = staged(rows.select("key").distinct(), "keys")
        known = staged(self.forward().select("key").join(small_side(keys), "key", "left_semi"), "replaced") if self.version else None
        count, kind = keys.count(), rows.schema["key"].dataType.simpleString()
        windows = _windows_of(count)
        dealt = rows.withColumn("w", _window_of("key", F.lit(windows))).repartition(self._tasks(count), "w").dropDuplicates(["w", "key"]).sortWithinPartitions("w", "key")
        words = dealt.select("key", "w", *[self.analysis.words(F.col(f"_{k}")).alias(f"_{k}") for k in range(len(fields))])
        made = words.mapInArrow(_counts([float(w) for w in fields.values()], self.analysis.phrases), _FORWARD.format(kind))
        return self._write(made, count, known, False, kind)

    def remove(self, keys: DataFrame, key: str) -> int:
        """Takes documents out, exactly: their postings no longer match, and no statistic has them any more."""
        gone = staged(keys.select(F.col(key).alias("key")).where("key is not null").distinct(), "gone")
        self._every("totals")
        return self._write(None, 0, gone, False, gone.schema["key"].dataType.simpleString())

    def compact(self) -> int:
        """All that is live as one segment; earlier ones are hidden, and may be deleted."""
        count, key = self.totals()[0], self._every("forward").schema["key"].dataType.simpleString()
        windows = _windows_of(count)
        live = self.forward().withColumn("w", _window_of("key", F.lit(windows))).repartition(self._tasks(count), "w").sortWithinPartitions("w", "key")
        return self._write(live, count, None, True, key)

    # reading

    def _without_removed(self, rows: DataFrame) -> DataFrame:
        if len(self.segments()) == 1:
            return rows
        removed = self._every("removed").groupBy("key").agg(F.max("segment").alias("_until"))
        return rows.join(small_side(removed), "key", "left").where(F.col("_until").isNull() | (F.col("_until") <= F.col("segment"))).drop("_until")

    def _gone(self) -> DataFrame | None:
        """Of each segment and window the keys that later segments removed; made once for a search."""
        segments = self.segments()
        if len(segments) == 1:
            return None
        of = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(self._known[n]["windows"]).alias("windows")) for n in segments])
        rows = self._every("removed").select("key", "segment", F.explode(of).alias("of")).where(F.col("segment") > F.col("of.n"))
        placed = rows.select(F.col("of.n").alias("segment"), _window_of("key", F.col("of.windows")).alias("w"), "key")
        return staged(placed.groupBy("segment", "w").agg(F.collect_set("key").alias("_gone")), "gone-by-window")

    @staticmethod
    def _by_window(blocks: DataFrame, values: list[str], windows: DataFrame | None = None) -> DataFrame:
        """term, segment and w with that window's part of the arrays. windows: the few that are wanted, or all."""
        each = blocks.select("term", "segment", *values, "ends", F.posexplode("ws").alias("_i", "w"))
        each = each if windows is None else each.join(F.broadcast(windows), ["segment", "w"], "left_semi")
        begin, end = F.coalesce(F.get("ends", F.col("_i") - 1), F.lit(0)), F.get("ends", F.col("_i"))
        return each.select("term", "segment", "w", *[F.slice(c, begin + 1, end - begin).alias(c) for c in values])

    @staticmethod
    def _live(rows: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
        """The postings of blocks that carry _gone, one a row; values: which of their arrays are wanted."""
        each = rows.select(*keep, "_gone", *values, F.posexplode("keys").alias("_at", "key"))
        left = each.where(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("key")))
        return left.select(*keep, "key", *[F.get(c, F.col("_at")).alias(c) for c in values])

    def forward(self) -> DataFrame:
        """The documents that are there: key, length and terms."""
        return self._without_removed(self._every("forward")).drop("segment", "w")

    def totals(self) -> tuple[int, int]:
        """Documents and words, as of this version."""
        facts = self._facts()
        return tuple(sum(facts[n][c] or 0 for n in self.segments()) for c in ("documents", "words"))

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """term and df of all terms, or of those given, whose folders alone are read."""
        rows = self._every("frequencies")
        if terms is not None:
            rows = self._of(rows, terms)
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _of(self, rows: DataFrame, terms: DataFrame) -> DataFrame:
        """The rows of some terms. At most FOLDERS numbers are collected."""
        terms, hint = bounded(terms)
        folders = [r["f"] for r in terms.select(_folder_of("term").alias("f")).distinct().collect()]
        return rows.where(F.col("folder").isin(folders)).join(hint(terms.select("term").distinct()), "term")

    def search(self, questions: DataFrame, question: str, k: int, text: str = "text", k1: float = 1.5, b: float = 0.75, positive: bool = True, read: list | None = None) -> DataFrame:
        """The k best documents of each question by BM25: question, key, score, rank. positive: ln(1 + ...) as idf, else
        the plain one, floored at 1e-6. read: gets (windows with a match, windows read), for reports."""
        phrases = question_terms(questions, question, T.tokens(F.col(text)))
        parts = self.analysis.words(F.col("term")) if self.analysis.phrases else F.array("term")
        phrases, hint = bounded(phrases.withColumn("parts", parts).where(F.size("parts") > 0))
        terms = staged(phrases.select(F.explode("parts").alias("term")).distinct(), "terms")
        n, words = self.totals()
        key = self._known[self.segments()[-1]]["key_type"]
        average = words / max(1, n)
        blocks = self._of(self._every("blocks"), terms)

        def idf(df: Column) -> Column:
            return F.ln(1 + (n - df + 0.5) / (df + 0.5)) if positive else F.greatest(F.lit(1e-6), F.ln((n - df + 0.5) / (df + 0.5)))

        def part(df: Column, f: Column, length: Column) -> Column:
            return idf(df) * f * (k1 + 1) / (f + k1 * (1 - b + b * length / F.lit(average)))

        # tokens of one part are terms of the index; of others the phrases are looked for, by document
        single = phrases.where(F.size("parts") == 1).select(question, F.col("parts")[0].alias("part"), F.col("term").alias("token"))
        df = staged(self.frequencies(terms), "frequencies")
        wanted = hint(single.join(hint(df), single["part"] == df["term"]).select(question, "token", "term", "df"))
        each = blocks.select("term", "segment", F.inline(F.arrays_zip("ws", "most", "least"))).join(wanted, "term")
        pieces = [each.select(question, "segment", F.col("ws").alias("w"), part(F.col("df"), F.col("most"), F.col("least")).alias("bound"))]
        found, gone = None, self._gone()
        tasks = self._tasks(n)
        if self.analysis.phrases:
            found = self._phrases(blocks, phrases.where(F.size("parts") > 1).select("term", "parts").distinct(), hint, gone, tasks)
            weights = found.groupBy("token").agg(F.count("*").alias("df"))
            found = found.join(hint(weights), "token").join(hint(phrases.select(question, F.col("term").alias("token"))), "token")
            found = staged(found.select(question, "token", "segment", "w", "key", part(F.col("df"), F.col("f"), F.col("length")).alias("score")), "phrases")
            pieces.append(found.groupBy(question, "token", "segment", "w").agg(F.max("score").alias("bound")).select(question, "segment", "w", "bound"))
        bounds = pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])
        bounds = staged(bounds.groupBy(question, "segment", "w").agg(F.sum("bound").alias("bound")), "bounds")

        def scored(windows: DataFrame) -> DataFrame:
            windows, few = bounded(windows.select(question, "segment", "w"))
            here = self._by_window(blocks, ["keys", "f", "lengths"], windows.select("segment", "w").distinct() if few is F.broadcast else None)
            live = self._live(by_window(here, windows).join(wanted, "term").where(F.array_contains("_for", F.col(question))), ["segment", "w", question, "df"], ["f", "lengths"])
            rows = live.select("segment", "w", question, "key", part(F.col("df"), F.col("f"), F.col("lengths")).alias("score"))
            if found is not None:
                more = by_window(found, windows).where(F.array_contains("_for", F.col(question)))
                rows = rows.unionByName(more.select("segment", "w", question, "key", "score"))
            return rows.groupBy("segment", "w", question, "key").agg(F.sum("score").alias("score")).select(question, "key", "score")

        def by_window(rows: DataFrame, windows: DataFrame) -> DataFrame:
            """rows dealt by window, each with its window's questions, _for, and what was removed, _gone."""
            each = windows.groupBy("segment", "w").agg(F.collect_list(question).alias("_for"))
            each = each.withColumn("_gone", F.lit(None).cast(f"array<{key}>")) if gone is None else each.join(gone, ["segment", "w"], "left")
            return rows.repartition(tasks, "segment", "w").join(each.repartition(tasks, "segment", "w").hint("shuffle_hash"), ["segment", "w"])

        order = Window.partitionBy(question).orderBy(F.desc("bound"), "segment", "w")
        first = staged(bounds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(FIRST, -(-k // 8))), "first-windows")
        best = staged(top(scored(first), [question], k, "key"), "first-best")
        floor = best.groupBy(question).agg(F.count("*").alias("_n"), F.min("score").alias("_floor")).where(F.col("_n") >= k)
        # scores are rounded to six digits
        reach = bounds.join(small_side(floor), question, "left").where(F.col("_floor").isNull() | (F.col("bound") >= F.col("_floor") - 2e-6))
        rest = staged(reach.join(first.select(question, "segment", "w"), [question, "segment", "w"], "left_anti").select(question, "segment", "w"), "other-windows")
        if read is not None:
            read.append((bounds.count(), first.count() + rest.count()))
        every = best.select(question, "key", "score").unionByName(top(scored(rest), [question], k, "key").select(question, "key", "score"))
        return top(every, [question], k, "key")

    def _phrases(self, blocks: DataFrame, phrases: DataFrame, hint, gone: DataFrame | None, tasks: int) -> DataFrame:
        """token, segment, w, key, length and f of the documents that have a phrase's parts one after another in a field."""
        parts = phrases.select(F.col("term").alias("token"), F.size("parts").alias("m"), F.posexplode("parts").alias("i", "term"))
        here = blocks.join(hint(parts.select("term").distinct()), "term", "left_semi")
        here = self._by_window(here, ["keys", "lengths", "places"]).repartition(tasks, "segment", "w")
        here = here.withColumn("_gone", F.lit(None).cast(f"array<{blocks.schema['keys'].dataType.elementType.simpleString()}>")) if gone is None else here.join(gone.repartition(tasks, "segment", "w").hint("shuffle_hash"), ["segment", "w"], "left")
        live = self._live(here, ["term", "segment", "w"], ["lengths", "places"])
        starts = live.join(hint(parts), "term").select("token", "m", "i", "segment", "w", "key", F.col("lengths").alias("length"), F.explode("places").alias("at")).withColumn("start", F.col("at") - F.col("i"))
        same = starts.where(F.floor(F.col("at") / FIELD) == F.floor(F.col("start") / FIELD))
        whole = same.groupBy("token", "m", "segment", "w", "key", "length", "start").agg(F.count("*").alias("c")).where("c = m")
        weight = F.element_at(F.array(*[F.lit(float(v)) for v in self.analysis.fields.values()]), (F.floor(F.col("start") / FIELD) + 1).cast("int"))
        return whole.groupBy("token", "segment", "w", "key", "length").agg(F.sum(weight).alias("f"))
