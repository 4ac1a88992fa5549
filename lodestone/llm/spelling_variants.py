"""Spelling variants: words one edit apart, and for each word the common form that it is a variant of.

The words, with their counts, are sorted by code points (long ones apart, by length) and cut into shards. A shard is a
compact trie in arrays: a node for each beginning that several words share, a leaf as soon as only one word is left, the
children of a node one after another. Shards are broadcast, as many at a time as PASS_BYTES hold, so the bound is on what is
broadcast and not on the vocabulary; a larger vocabulary takes more passes. Tasks take the words in blocks and intersect each
word's distance-one Levenshtein automaton with every shard, depth first: a block of states (word, place in it, node,
whether the edit is spent) is taken from a stack, moved along all edges, and the states it leads to are put back; leaves are
decided by comparing what is left of both words. Repeats within a word are edited at their last place only, so each
neighbour is reached on one path. Of the neighbours a task sends on only their number and the best one; passes are added up.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word
of largest count (ties: smallest in code-point order) if that has at least TIMES its count; the root is the last form of
forms. Counts grow at least TIMES-fold on the way, so forms never run in a circle and the way is short.

Null texts have no words, a null doc_id counts as an empty text, repeated rows count again. Texts and words may be of any
length. An empty table has no words. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, lean, met, staged

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Words a shard, code points that the words of a shard or block may fill as a table, bytes that are broadcast at once.
SHARD_WORDS, CELLS, PASS_BYTES = 1 << 15, 1 << 22, 64 << 20
#: Words a task, words that are asked together, states that are moved together, and up to which length words are sorted as one class.
TASK_WORDS, ASKED, STATES, PLAIN_LENGTH = 1 << 14, 1 << 12, 1 << 16, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, misspelt: int = 199, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: runs of letters, A-Z in lower case; a run loses a code point where `misspelt` divides its checksum with
    the document's id."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % misspelt == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    counted = each.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def code_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points as rows of one table, filled up with zeros, and their lengths."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    table = np.zeros((len(words), int(size.max(initial=0)) + 2), np.uint32)
    table[np.arange(table.shape[1]) < size[:, None]] = flat
    return table, size


class Trie:
    """A compact trie of sorted distinct words. Node 0 is the root; `label` is the code point that leads to a node, `depth`
    how many do, `child` and `many` where its children are, `word` the word that ends at it, or a leaf's only word."""

    def __init__(self, label, depth, child, many, word, counts, text, ends):
        self.label, self.depth, self.child, self.many, self.word, self.counts = label, depth, child, many, word, counts
        whole = text.tobytes().decode()
        self.words = [whole[a:b] for a, b in zip(np.append(0, ends).tolist(), ends.tolist(), strict=False)]
        self.table, self.size = code_table(self.words)
        # children follow one another in the order of nodes and labels, so edges are sorted
        parent = np.repeat(np.arange(len(many)), many)
        self.edges = parent.astype(np.int64) << 21 | label[1:]

    @staticmethod
    def built(words: list[str], counts: list[int]) -> dict[str, np.ndarray]:
        """The arrays of the trie of at least one word."""
        table, size = code_table(words)
        differ = table[1:] != table[:-1]
        common = np.append(0, np.argmax(differ, 1))
        parts = {"label": [np.zeros(1, np.uint32)], "depth": [np.zeros(1, np.int32)], "child": [], "many": [], "word": []}
        low, high, depth, made = np.zeros(1, np.int64), np.array([len(words)]), 0, 1
        leaf = high - low == 1
        while len(low):
            ends = ~leaf & (size[low] == depth)
            parts["word"].append(np.where(leaf | ends, low, -1).astype(np.int32))
            inner, first = np.flatnonzero(~leaf), (low + ends)[~leaf]
            count = high[inner] - first
            rows = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))
            owner = np.repeat(inner, count)
            fresh = np.append(True, owner[1:] != owner[:-1])[: len(rows)] | (common[rows] == depth)
            at = np.flatnonzero(fresh)
            many = np.bincount(owner[at], minlength=len(low))
            parts["many"].append(many.astype(np.int32))
            parts["child"].append((made + np.append(0, np.cumsum(many)[:-1])).astype(np.int32))
            made += len(at)
            low = rows[at]
            stop = np.append(at[1:], len(rows))
            high = low + stop - at
            depth += 1
            parts["label"].append(table[low, depth - 1])
            parts["depth"].append(np.full(len(low), depth, np.int32))
            leaf = high - low == 1
        return {k: np.concatenate(v) for k, v in parts.items()} | {"counts": np.array(counts, np.int64), "text": np.frombuffer("".join(words).encode(), np.uint8), "ends": np.cumsum(size)}


def _blocks(rows: Iterator[tuple[str, int]], most: int, in_order: bool = False) -> Iterator[list[tuple[str, int]]]:
    """Rows in blocks of at most `most` words whose table has about CELLS places; if in_order, each with ascending words."""
    held: list[tuple[str, int]] = []
    wide = 0
    for row in rows:
        if held and (len(held) >= most or (len(held) + 1) * max(wide, len(row[0])) > CELLS or in_order and row[0] <= held[-1][0]):
            yield held
            held, wide = [], 0
        held.append(row)
        wide = max(wide, len(row[0]))
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def trie_shards(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The words (word, n) in shards: name, bytes and the trie's arrays."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(_rows(batches), shard_words, in_order=True):
            file = io.BytesIO()
            np.savez(file, **Trie.built([w for w, _ in held], [n for _, n in held]))
            yield pa.record_batch({"name": [held[0][0]], "bytes": pa.array([len(file.getvalue())], pa.int64()), "arrays": pa.array([file.getvalue()], pa.binary())})

    long = F.when(F.length("word") <= PLAIN_LENGTH, 0).otherwise(F.floor(F.log2(F.length("word").cast("double"))))
    ordered = words.select("word", "n", long.cast("int").alias("class")).repartitionByRange("class", "word").sortWithinPartitions("class", "word")
    return ordered.mapInArrow(run, "name string, bytes long, arrays binary")


def neighbours(table: np.ndarray, size: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of the table, word of the trie) that are one edit apart."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    near = np.flatnonzero((size >= trie.size.min() - 1) & (size <= trie.size.max() + 1))
    start = np.zeros(len(near), np.int64)
    stack = [(near, start, start, False)] if len(near) else []
    width = min(table.shape[1], trie.table.shape[1])
    place = np.arange(width)

    def put(q, i, node, spent) -> None:
        """States on leaves are decided, others go on the stack."""
        leaf = trie.many[node] == 0
        if leaf.any():
            decide(q[leaf], i[leaf], node[leaf], spent)
            q, i, node = q[~leaf], i[~leaf], node[~leaf]
        for lo in range(0, len(q), STATES):
            stack.append((q[lo : lo + STATES], i[lo : lo + STATES], node[lo : lo + STATES], spent))

    def decide(q, i, node, spent) -> None:
        word = trie.word[node]
        more = trie.size[word] - size[q]
        # with the edit spent, as much has to be left of both; else one word may be longer by one
        shift = trie.depth[node] - i
        fits = more == shift if spent else np.abs(more) <= 1
        for d in (-1, 0, 1):
            at = np.flatnonzero(fits & (more == d))
            for lo in range(0, len(at), max(1, CELLS // width)):
                part = at[lo : lo + max(1, CELLS // width)]
                a, b = table[q[part]], trie.table[word[part]]
                a, b = a[:, : width], b[:, : width]
                differ = a != b
                if spent:
                    begin = i[part]
                elif d:
                    begin = np.argmax(differ, 1) + (d < 0)
                else:
                    good = differ.sum(1) == 1
                    found.append((q[part][good], word[part][good]))
                    continue
                # from there on the words are equal but for the shift
                if d > 0:
                    differ = a[:, :-1] != b[:, 1:]
                elif d < 0:
                    differ = np.concatenate([np.zeros((len(part), 1), bool), a[:, 1:] != b[:, :-1]], 1)
                good = ~(differ & (place[: differ.shape[1]] >= begin[:, None])).any(1)
                found.append((q[part][good], word[part][good]))

    if stack and trie.many[0] == 0:
        q, i, node, _ = stack.pop()
        decide(q, i, node, False)
    while stack:
        q, i, node, spent = stack.pop()
        left = size[q] > i
        own = table[q, i]
        if spent:
            ended = ~left & (trie.word[node] >= 0)
            found.append((q[ended], trie.word[node[ended]]))
            q, i, node, own = q[left], i[left], node[left], own[left]
            key = node.astype(np.int64) << 21 | own
            at = np.minimum(np.searchsorted(trie.edges, key), len(trie.edges) - 1)
            good = trie.edges[at] == key
            put(q[good], i[good] + 1, at[good] + 1, True)
            continue
        # the word has a code point more: it is skipped, at the last of its repeats
        skip = left & (table[q, i + 1] != own)
        put(q[skip], i[skip] + 1, node[skip], True)
        many = trie.many[node].astype(np.int64)
        of = np.repeat(np.arange(len(q)), many)
        child = np.repeat(trie.child[node] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(int(many.sum()))
        same = left[of] & (trie.label[child] == own[of])
        put(q[of[same]], i[of[same]] + 1, child[same], False)
        of, child = of[~same], child[~same]
        put(q[of], i[of], child, True)
        inside = left[of]
        put(q[of[inside]], i[of[inside]] + 1, child[inside], True)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_words(words: DataFrame, shards: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """For each word that has near ones: how many, and the best one with its count. Shards come from the driver in passes
    of at most pass_bytes, and at least one shard."""
    spark = words.sparkSession
    # one row a shard: its first word and size
    names = sorted(shards.select("name", "bytes").collect())
    passes, held = [[]], 0
    for name, size in names:
        if passes[-1] and held + size > pass_bytes:
            passes.append([])
            held = 0
        passes[-1].append(name)
        held += size
    out = None
    for chosen in passes:
        arrays = [bytes(r["arrays"]) for r in shards.where(F.col("name").isin(chosen)).select("arrays").collect()] if chosen else []
        sent = spark.sparkContext.broadcast(arrays)

        @lean
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tries = []
            for raw in sent.value:
                with np.load(io.BytesIO(raw)) as a:
                    tries.append(Trie(**a))
            for held in _blocks(_rows(batches), ASKED):
                asked = [w for w, _ in held]
                table, size = code_table(asked)
                near, best = np.zeros(len(asked), np.int64), [(0, "")] * len(asked)
                for t in tries:
                    q, w = neighbours(table, size, t)
                    near += np.bincount(q, minlength=len(asked))
                    # the words of a shard are in order, so the first of the largest count is the smallest word
                    order = np.lexsort((w, -t.counts[w], q))
                    q, w = q[order], w[order]
                    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))[: len(q)]
                    for k in first.tolist():
                        mine = (-int(t.counts[w[k]]), t.words[w[k]])
                        if mine < best[q[k]]:
                            best[q[k]] = mine
                some = np.flatnonzero(near)
                if len(some):
                    yield pa.record_batch({"word": [asked[k] for k in some.tolist()], "n_near": pa.array(near[some]), "less": pa.array([best[k][0] for k in some.tolist()], pa.int64()), "near": [best[k][1] for k in some.tolist()]})

        got = staged(words.select("word", "n").mapInArrow(run, "word string, n_near long, less long, near string"), "near-words")
        sent.unpersist()
        out = got if out is None else out.unionByName(got)
    best = out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def grouped_variants(words: DataFrame, times: int = TIMES, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n of counted words (word, n; distinct words)."""
    words = staged(words, "words")
    # words are few bytes and much work, so they are dealt by their number
    tasks = max(1, -(-words.count() // TASK_WORDS))
    near = near_words(words.repartition(tasks, "word"), staged(trie_shards(words, shard_words), "tries"), pass_bytes)
    rare = F.col("near_n") >= times * F.col("n")
    known = staged(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(rare, F.col("near")).alias("form"), F.when(rare, F.col("near_n")).alias("form_n")), "forms")
    step = cut(known.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        # each round doubles how far along the forms a root is
        ahead = step.join(step.groupBy(F.col("root").alias("word")).agg(F.count("*").alias("_rows")), "word").select(F.col("word").alias("root"), F.col("root").alias("beyond"), "_rows")
        ahead = cut(ahead)
        if ahead.isEmpty():
            break
        step = cut(met(step, ahead, ["root"], "_rows", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return known.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, misspelt: int = 199, **settings) -> DataFrame:
    """The contract's rows from documents."""
    return grouped_variants(word_counts(docs, misspelt), **settings)
