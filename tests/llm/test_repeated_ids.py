"""Different texts of one id: no crash, no lost link, no text cut or dropped for another one's sake."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lodestone.llm import jaccard_join, suffix_dedup, token_files
from lodestone.llm.queries import TOKENIZER

from .fixtures import frame, words

SCHEMA = "doc_id long, text string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def passage():
    return " ".join(words(random.Random(11), 70))


def test_spans_belong_to_a_text(spark, passage):
    rows = [(0, passage), (1, "before " + passage), (1, "hi there"), (1, "before " + passage), (2, "unrelated words here")]
    spans = Counter((r.doc_id, r.start, r.end, tuple(r.sources)) for r in suffix_dedup.repeated_spans(table(spark, rows)).collect())
    assert spans == Counter({(1, 1, 71, (0,)): 1})
    left = Counter((r.doc_id, r.text, r.n_chars) for r in suffix_dedup.without_repeats(table(spark, rows)).collect())
    assert left == Counter({(0, passage, len(passage)): 1, (1, "before ", 7): 2, (1, "hi there", 8): 1, (2, "unrelated words here", 20): 1})


def test_longer_text_of_the_same_id_is_not_cut(spark, passage):
    other = " ".join(words(random.Random(12), 200))
    rows = [(5, passage), (7, passage), (7, other), (None, passage)]
    left = Counter((r.doc_id, r.text) for r in suffix_dedup.without_repeats(table(spark, rows)).collect())
    assert left == Counter([(5, passage), (7, other), (None, passage)])


def test_two_texts_of_one_id_repeat_each_other(spark, passage):
    rows = [(3, passage + " end"), (3, "start " + passage)]
    left = [r.text for r in suffix_dedup.without_repeats(table(spark, rows)).collect()]
    assert sorted(passage in t for t in left) == [False, True]


def test_links_belong_to_a_text(spark):
    rng = random.Random(3)
    one, two = words(rng, 120), words(rng, 120)
    near = lambda w: " ".join(["other", *w[1:]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, "alone")]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(table(spark, rows)).collect())
    assert got == Counter({(1, 1, 1): 2, (2, 1, 1): 1, (3, 1, 1): 1, (4, 4, 0): 1})
    rows.append((2, "a text of its own that nobody else has"))
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(table(spark, rows)).collect())
    assert kept == Counter([rows[0], rows[1], rows[4], rows[5]])


def test_hot_id(spark):
    """A third of all rows have one id and texts of their own."""
    rng = random.Random(8)
    rows = [(9 if k % 3 == 0 else k, " ".join(words(rng, 60))) for k in range(300)]
    rows += [(1000 + k, rows[3 * k][1] + " more") for k in range(50)]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(table(spark, rows)).collect())
    assert got == Counter([(i, i, 0) for k, (i, _) in enumerate(rows[:300]) if not (k % 3 == 0 and k < 150)] + [(9, 9, 1)] * 50 + [(1000 + k, 9, 1) for k in range(50)])
    assert suffix_dedup.without_repeats(table(spark, rows)).count() == 350


def test_groups_in_one_task_and_over_partitions(spark, monkeypatch):
    from lodestone.llm import shared

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000 + k) for k in range(100)] + [(None, 1), (2, 2)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    expected = {x: find(x) for x in list(root)}
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (200_000, 0):
        monkeypatch.setattr(shared, "SMALL_GRAPH", most)
        assert {r.node: r.root for r in shared.linked_groups(df).collect()} == expected


def test_clashing_names(spark, passage):
    rows = [(0, passage), (1, "before " + passage), (1, "hi there")]
    d = frame(spark, [(i, t, "en", "s", len(t), "k", "c", "s") for i, t in rows]).selectExpr("*", "1 as number_0", "2 as away_0", "3 as text_0", "4 as text_hash")
    for out, left in ((suffix_dedup.without_repeats(d), 3), (jaccard_join.keep_one(d), 2)):
        assert out.columns == d.columns and out.count() == left


def test_token_blocks_of_one_id(spark):
    """Rows without ids, and rows of one id and text, are sorted over several ranges."""
    rows = [(None, f"text {k}") for k in range(600)] + [(4, "the same text")] * 600 + [(1, "first")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = token_files.write_blocks(table(spark, rows).repartition(4), TOKENIZER, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert blocks.where("array_contains(doc_ids, 4)").select("part").distinct().count() > 1
    got = token_files.document_digests(blocks).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 600 + [1] + [4] * 600
    assert [r.start for r in got[1:]] == [r.start + r.n_tokens for r in got[:-1]] and len({r.ids_crc32 for r in got[601:]}) == 1
