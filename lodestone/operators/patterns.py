"""Many fixed strings looked for in many texts at once.

The strings are dealt into passes of bounded size; a pass goes to the workers as one broadcast list. There each string is
found by an Aho-Corasick automaton over a window of WINDOW characters of it, so the automaton's size is bounded by the number
of strings and not by their lengths, and a window that is met is confirmed by comparing the whole string. Each text is read
once a pass, whatever the number of strings; no pairs of texts and strings are formed but those that match.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

WINDOW = 32
#: Strings of a pass, and their characters together (unless one string alone has more).
PASS_PATTERNS, PASS_CHARACTERS = 50_000, 32 << 20


class Automaton:
    """Finds which of some strings (not empty) a text has."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.windows = ahocorasick.Automaton()
        self.patterns = patterns
        for k, p in enumerate(patterns):
            # the middle, which tells strings that begin or end alike apart
            at = max(0, (len(p) - WINDOW) // 2)
            window = p[at : at + WINDOW]
            self.windows.add_word(window, [*self.windows.get(window, []), (k, at)])
        if patterns:
            self.windows.make_automaton()

    def found(self, text: str) -> set[int]:
        """The places in the list of the strings that the text has."""
        out: set[int] = set()
        if not self.patterns:
            return out
        for end, here in self.windows.iter(text):
            for k, at in here:
                if k not in out:
                    p = self.patterns[k]
                    start = end + 1 - min(WINDOW, len(p)) - at
                    if start >= 0 and text.startswith(p, start):
                        out.add(k)
        return out


def containing(docs: DataFrame, doc: str, text: str, patterns: DataFrame, pattern: str, counts: bool = False, most: int = PASS_PATTERNS) -> DataFrame:
    """(doc, pattern) for every distinct pattern that a text holds, as it is written; with counts, (pattern, matched): how
    many rows hold it. Null texts hold nothing, a null pattern is in no text, the empty one in every text."""
    asked = staged(patterns.select(F.col(pattern).alias("_p")).where("_p is not null").distinct(), "patterns")
    size = asked.agg(F.count("*").alias("n"), F.sum(F.length("_p")).alias("c")).first()
    passes = max(1, -(-size["n"] // most), -(-(size["c"] or 0) // PASS_CHARACTERS))
    key, kind = ("_d", f"_d {docs.schema[doc].dataType.simpleString()}, ") if not counts else (None, "")
    rows = docs.select(F.col(text).alias("_t"), *([] if counts else [F.col(doc).alias("_d")])).where("_t is not null")
    out = None
    for at in range(passes):
        # a pass is bounded by PASS_PATTERNS and PASS_CHARACTERS, dealt by hash
        part = asked.where((F.length("_p") > 0) & (F.pmod(F.xxhash64("_p"), F.lit(passes)) == at))
        sent = docs.sparkSession.sparkContext.broadcast([r["_p"] for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton, total = None, {}
            for b in batches:
                automaton = automaton or Automaton(sent.value)
                texts = b.column(0).to_pylist()
                found = [automaton.found(t) for t in texts]
                if counts:
                    for f in found:
                        for k in f:
                            total[k] = total.get(k, 0) + 1
                    continue
                own = [i for i, f in enumerate(found) for _ in f]
                if own:
                    yield pa.record_batch({"_d": b.column(1).take(pa.array(own)), "_p": pa.array([automaton.patterns[k] for f in found for k in f], pa.string())})
            if total:
                yield pa.record_batch({"_p": pa.array([automaton.patterns[k] for k in total], pa.string()), "n": pa.array([*total.values()], pa.int64())})

        got = rows.mapInArrow(run, f"{kind}_p string" + (", n long" if counts else ""))
        got = got if passes == 1 else staged(got, "patterns-found")
        out = got if out is None else out.unionByName(got)
    empty = asked.where("_p = ''")
    if counts:
        out = out.unionByName(empty.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))))  # one row each
        return out.groupBy("_p").agg(F.sum("n").alias("matched")).withColumnRenamed("_p", pattern)
    out = out.unionByName(rows.select("_d").crossJoin(F.broadcast(empty)))  # at most the one empty pattern
    return out.select(F.col("_d").alias(doc), F.col("_p").alias(pattern))
