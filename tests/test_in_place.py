"""Matches and term weights are found where a document's words lie, and come to the same where they are joined by shuffle."""

import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, retrieval, staging, vectors

WEIGHTS = {"text": 1.0, "title": 0.6}
DOCS = [
    (1, "river stone river in-process", "Stone"), (2, "in process of process stones", None), (3, "stone a.b.a b a b a", "river"), (4, None, ""),
    (5, "river in-process", "in-process"), (5, "process stone river lake", "x"), (None, "river lake", "lake"), (None, "lake", None), *[(k, f"word{k} lake", "t") for k in range(6, 40)],
]
ASKED = [(0, "river stone"), (1, "in-process a.b"), (2, "lake a.b.a river"), (3, None), (4, "nothing-here")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _by_hand():
    plain = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    rows = [(key, [(WEIGHTS["text"], plain(a)), (WEIGHTS["title"], plain(b))]) for key, a, b in DOCS]
    long = [sum(len(ws) for _, ws in fields) for _, fields in rows]
    terms = {q: {t.lower() for t in re.findall(r"[A-Za-z0-9_]+(?:[.\-/][A-Za-z0-9_]+)*", s or "")} for q, s in ASKED}
    found: dict = {}
    for term in set().union(*terms.values()):
        p = plain(term)
        for key, fields in rows:
            f = sum(w * sum(ws[i : i + len(p)] == p for i in range(len(ws))) for w, ws in fields)
            if f:
                found.setdefault(term, Counter())[key] += f
    n, average, out = len(rows), sum(long) / len(rows), {}
    for q, ts in terms.items():
        for t in ts & found.keys():
            df = len(found[t])
            idf = max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))
            for (key, _), d in zip(rows, long, strict=True):
                if key is not None and key in found[t]:
                    f = found[t][key]
                    out[q, key] = out.get((q, key), 0.0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / average))
    return out


@pytest.mark.parametrize("most", [staging.BROADCAST_BYTES, 0])
def test_field_search_by_hand(spark, monkeypatch, most):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", most)
    monkeypatch.setattr(lexical, "MATCH_ROWS", 7)
    monkeypatch.setattr(lexical, "SCORES", 12)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    asked = spark.createDataFrame(ASKED, "item_id int, text string")
    found = lexical.field_bm25(docs, asked, "doc_id", "item_id", WEIGHTS, stems=False)
    # no token and no match is a row, unless the sides are too large for a task
    assert ("Generate" in _plan(found)) == (most == 0)
    rows = found.collect()
    got, want = {(r.item_id, r.doc_id): r.score for r in rows}, _by_hand()
    assert len(got) == len(rows) and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    best = lambda df: sorted(map(tuple, lexical.top(df, ["item_id"], 2, "doc_id").collect()))
    few = lexical.field_bm25(docs, asked, "doc_id", "item_id", WEIGHTS, stems=False, k=2)
    assert best(few) == best(found)
    # what may not be found still counts
    only = lexical.field_words(docs, "doc_id", WEIGHTS, stems=False, only=F.col("doc_id") % 2 == 1)
    odd = lexical.field_bm25(docs, asked, "doc_id", "item_id", words=only)
    assert {(r.item_id, r.doc_id): round(r.score, 9) for r in odd.collect()} == {x: round(v, 9) for x, v in want.items() if x[1] % 2 == 1}
    assert lexical.field_bm25(docs.limit(0), asked, "doc_id", "item_id", WEIGHTS).count() == 0 == lexical.field_bm25(docs, asked.limit(0), "doc_id", "item_id", WEIGHTS).count()


def test_terms_are_weighed_where_their_rows_lie(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([d[1] for d in DOCS])], "doc_id long, text string")
    terms = spark.createDataFrame([("river", 0.5), ("in-process", 3.0), ("lake", None)], "term string, idf double")
    read = lambda df: {r.doc_id: np.array(r.vector) for r in df.collect()}
    made = vectors.embed(docs, terms, "doc_id")
    assert "Generate" not in _plan(made) and "Aggregate" not in _plan(made)
    got = read(made)
    monkeypatch.setattr(vectors, "WEIGHT_BYTES", 0)
    want = read(vectors.embed(docs, terms, "doc_id"))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    default = math.log(1 + (len(DOCS) + 0.5) / 0.5)
    words = ["river", "stone", "river", "in-process"]
    assert np.allclose(got[0], vectors.embed_tokens(words, {"river": 0.5, "in-process": 3.0}, default), atol=1e-6) and not got[3].any()
    assert vectors.embed(docs.limit(0), terms, "doc_id").count() == 0 and len(read(vectors.embed(docs, terms.limit(0), "doc_id"))) == len(DOCS)


def test_filters_reach_the_vectors_without_a_join(spark):
    docs = spark.createDataFrame([(1, "river", True), (2, "river stone", False), (3, "lake", None), (4, "stone", False), (4, "river", True)], "doc_id long, text string, allowed boolean")
    terms = spark.createDataFrame([("river", 0.5)], "term string, idf double")
    made = vectors.embed(docs, terms, "doc_id", flag="allowed")
    assert sorted((r.doc_id, r.allowed) for r in made.collect()) == [(1, True), (2, False), (3, False), (4, True), (4, True)]
    # the files of a search's own tables go once they are read; what it found stays
    chunks = docs.where("doc_id < 4").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text", F.lit("").alias("title"), F.lit("").alias("context_header"), F.when(F.col("allowed"), "a").otherwise("b").alias("source_system"))
    filters = {"exclude_source": ["b"]}
    marked = staging.staged(vectors.embed(chunks.withColumn("allowed", retrieval.may_be_found(filters)), terms, "chunk_id", flag="allowed"), "vectors")
    asked = spark.createDataFrame([(0, "river")], "item_id long, text string")
    at = vectors.embed(asked, terms, "item_id")
    joined = retrieval.arms(chunks, vectors.embed(chunks, terms, "chunk_id"), asked, at, "item_id", filters=filters)
    found = retrieval.arms(chunks, marked, asked, at, "item_id", filters=filters, spent=True)
    assert not os.path.exists(marked.staged_at)
    for arm in ("dense", "lexical"):
        assert [r.chunk_id for r in found[arm].collect()] == ["1"] == [r.chunk_id for r in joined[arm].collect()]
