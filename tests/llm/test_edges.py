"""Edge cases of the operators, and the pipeline stage by stage against brute-force versions of its operators."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import best_fit_packing, gif_media, jaccard_join, quality_rules, shared, suffix_dedup, tag_paths, textarrays, weak_quality
from lodestone.llm.queries import TOKENIZER

from .fixtures import SCHEMA, documents, frame
from .test_operators import WORD, links_by_brute_force, spans_by_brute_force


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with everything that has to be defined, and labels of some of them."""
    at = str(tmp_path_factory.mktemp("sf"))
    frame(spark).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(len((t or "").split()) > 40 and "$$$" not in t), 0) for i, t, *_ in documents() if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, rules), (_, classifier), (_, join), (_, dedup), (_, packing) = corpus_pipeline.STAGES
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    verdicts = quality_rules.quality_rules(docs, quality_rules.fitted(docs, labels)).collect()
    good = Counter((r.doc_id, r.n_words, r.word_chars) for r in verdicts if r.kept)
    one = shared.staged(rules(spark, docs, folder), "one")
    assert one.columns == docs.columns
    assert Counter((r.doc_id, len(WORD.findall(r.text)), sum(map(len, WORD.findall(r.text)))) for r in one.collect()) == good
    assert not as_rows(one) - as_rows(docs) and all(len(WORD.findall(r.text)) >= 50 for r in one.collect())

    scorer = weak_quality.fitted(one)[1]
    kept = {(r.doc_id, r.score) for r in weak_quality.classified(one, scorer).collect() if r.kept}
    two = shared.staged(classifier(spark, one, folder), "two")
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == {i for i, _ in kept} and not as_rows(two) - as_rows(one)

    before = [tuple(r) for r in two.collect()]
    classes = {i: c for i, c, _ in links_by_brute_force([r for r in before if r[0] is not None])}
    three = shared.staged(join(spark, two, folder), "three")
    assert as_rows(three) == Counter(r for r in before if r[0] is None or classes[r[0]] == r[0])

    before = [tuple(r) for r in three.collect()]
    spans = defaultdict(list)
    for i, a, b in spans_by_brute_force(before, 50):
        spans[i].append((a, b))
    left = lambda i, text: [w for k, w in enumerate(WORD.findall(text)) if i is None or not any(a <= k < b for a, b in spans[i])]
    four = shared.staged(dedup(spark, three, folder), "four")
    assert four.columns == docs.columns
    assert Counter((r.doc_id, tuple(WORD.findall(r.text))) for r in four.collect()) == Counter((r[0], tuple(left(r[0], r[1]))) for r in before if left(r[0], r[1]))
    assert all(r.n_chars == len(r.text) for r in four.collect() if spans[r.doc_id])

    got = packing(spark, four, folder).collect()
    pieces = best_fit_packing.pieces(four, TOKENIZER, 0).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(tuple(r) for r in pieces)
    full = defaultdict(int)
    for r in got:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048
    assert as_rows(corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32")) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_reach_the_end(spark):
    """Names that operators use for themselves, collected."""
    names = ("_spans", "_spans_of", "spans_0", "spans_of_0", "root", "k1", "cid", "_rows", "places", "words", "hash", "media", "bucket")
    d = frame(spark)
    for n in names:
        d = d.selectExpr("*", f"'{n}' as `{n}`")
    for out in (suffix_dedup.without_repeats(d), jaccard_join.keep_one(d), quality_rules.keep_good(d, None), weak_quality.keep_good(d, None)):
        rows = out.collect()
        assert out.columns == d.columns and rows and all(r[n] == n for r in rows for n in names)
    assert jaccard_join.near_duplicates(d).count() == len(documents())
    assert best_fit_packing.packed(d, TOKENIZER).count() >= len(documents())
    assert gif_media.media_digests(gif_media.with_media(d)).count() == len(documents())


def test_null_and_damaged_media(spark):
    whole = gif_media.gif_of(bytes(range(192)) * 3)
    rows = spark.createDataFrame([(1, 9, whole), (2, 9, None), (3, 9, whole[:-40]), (4, 9, b"")], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in gif_media.media_digests(rows).collect()}
    assert got[1].error is None and got[1].payload_bytes == 576 and got[1].feature.startswith("frames=1;cs=10;grey=")
    assert all(got[k].error and got[k].payload_sha256 is got[k].feature is None for k in (2, 3, 4))


def test_rows_without_ids_are_dealt_over_buckets(spark):
    rows = [(None, "same text here", *[None] * 6)] * 400
    got = best_fit_packing.packed(frame(spark, rows), TOKENIZER, bucket=40).collect()
    assert len(got) == 400 and len({r.sequence_id for r in got}) > 3


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session())


def test_long_texts_are_hashed_in_parts():
    data = np.frombuffer(("word é x " * 5000).encode(), np.uint8)
    t = textarrays.Texts(data, np.array([0, len(data)]), 0)
    assert (textarrays.span_hashes(data, t.starts, t.ends, 100) == t.hashes()).all()


def test_deep_pages_take_linear_memory():
    deep = "<div class=a>" * 100_000 + "<p>Text here, with marks.</p>" + "</div>" * 100_000
    assert tag_paths.main_text(deep) == "Text here, with marks."
    many = "<article>" + "".join(f"<div><p>Line {k}, with words.</p>" for k in range(5000))
    assert tag_paths.main_text(many).count("\n") == 4999


def test_registered_without_a_missing_library(monkeypatch):
    """Where a library of the subpackage is missing, the other queries are still there."""
    import importlib

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "tokenizers", None)
    for name in [m for m in sys.modules if m.startswith("lodestone.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lodestone.llm", None)
    entry = importlib.reload(__spark_entry__)
    assert "search_bm25" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.undo()
    assert "pipeline" in importlib.reload(__spark_entry__).queries()
