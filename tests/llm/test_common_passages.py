"""Passages of very many documents: few rows leave a piece of their run, and spans and sources stay exact."""

from __future__ import annotations

import random

from lodestone.llm import suffix_dedup

from .fixtures import words
from .test_operators import spans_by_brute_force


def rows_with_copies(copies: int) -> list[tuple]:
    """Exact copies, near copies, a common passage in texts of their own and twice in one, and a row that is there again."""
    rng = random.Random(3)
    base, common = words(rng, 60), words(rng, 40)
    texts = [words(rng, 5) + base[20:45] + words(rng, 5)] + [base] * copies
    for _ in range(60):
        near = list(base)
        near[rng.randrange(len(near))] = "changed" + str(rng.randrange(40))
        texts.append(near)
        texts.append(words(rng, rng.randrange(20)) + common[rng.randrange(9) :] + words(rng, rng.randrange(20)))
    texts += [base + words(rng, 8) + base, common + words(rng, 8) + common[5:]] * 3
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + rows[9:30]


def test_common_passages_are_few_rows(spark, monkeypatch):
    rows, sorted_rows, plain = rows_with_copies(250), [], suffix_dedup._later_ones

    def counted(found):
        sorted_rows.append(found.count())
        return plain(found)

    monkeypatch.setattr(suffix_dedup, "_later_ones", counted)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "64")  # a piece has at least one batch
    try:
        got = {(r.doc_id, r.start, r.end): list(r.sources) for r in suffix_dedup.repeated_spans(d, 12, 6, 64).collect()}
    finally:
        spark.conf.set(size, before)
    assert got == spans_by_brute_force(rows, 12)
    # each of the copies has 49 passages; those of a piece's inner copies are not sorted again
    assert 0 < sorted_rows[0] < 250 * 49 / 2
