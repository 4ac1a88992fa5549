"""The loop around the index, templates of headings, sitemaps, the embedder, and searches on the index itself."""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions.stemming import porter_stem
from lodestone.operators import cycle, index, lexical, retrieval, templates, vectors
from lodestone.sources import pages

RAW = "source_system string, external_id string, uri string, title string, text string"


def test_meta_is_the_value_set_last(spark, tmp_path):
    at = str(tmp_path / "meta")
    assert cycle.get_meta(spark, at, "a", 7) == 7
    cycle.set_meta(spark, at, {"a": {"n": 1}, "b": [1, 2]})
    cycle.set_meta(spark, at, {"a": None, "c": "x"})
    assert cycle.get_meta(spark, at, "b") == [1, 2] and cycle.get_meta(spark, at, "a") is None and cycle.get_meta(spark, at, "c") == "x"


def test_a_cycle_acts_by_priority_within_its_budget(spark, tmp_path):
    kinds = "coverage double, fingerprint_mismatch boolean, previous_pass_rate double, pass_rate double, growth double, degradation string, content_changed boolean, documents long"
    situation = spark.createDataFrame([(0.5, True, 0.9, 0.9, 0.0, None, False, 9)], kinds)
    health = spark.createDataFrame([("web", 9, 0.5, 4, 999.0), ("files", 9, 0.0, 0, 1.0)], "source string, runs long, failure_rate double, consecutive_failures long, hours_since_success double")
    ran = []
    acts = {"embed_missing": lambda s: ran.append("embed") or 3, "reindex": lambda s: 1 / 0, "quarantine_source": lambda s: ran.append(s)}
    done = cycle.cycle(spark, str(tmp_path / "j"), 1, situation, health, "source", acts, budget=2)
    assert [(d["kind"], bool(d["error"])) for d in done] == [("embed_missing", False), ("reindex", True)] and ran == ["embed"]
    phases = index.read_journal(spark, str(tmp_path / "j"), cycle=1).collect()
    assert [p.phase for p in phases] == ["observe", "orient", "decide", "act"] and json.loads(phases[2].payload)["deferred"]
    quiet = spark.createDataFrame([(1.0, False, 0.9, 0.9, 0.0, None, False, 9)], kinds)
    assert [d["kind"] for d in cycle.cycle(spark, str(tmp_path / "j"), 2, quiet, health.where("source = 'files'"), "source", acts)] == ["noop"]


def test_reports_as_json_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", None)], "n int, s string, x double")
    cycle.write_report(df, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value) == {"n": 1, "s": "a|b"}
    assert cycle.as_markdown(df).splitlines() == ["| n | s | x |", "| --- | --- | --- |", "| 1 | a\\|b |  |"]


def test_sections_of_a_template_go(spark):
    body = lambda k: f"# Page {k}\ntext {k}\n## Share\nfollow us\n### More\nlinks\n## Own {k}\nkept\n```\n## Share\n```\n"
    docs = spark.createDataFrame([("s", k, body(k)) for k in range(6)] + [("t", 9, body(9))], "source string, doc_id int, text string")
    found = templates.learned_headings(docs, "source")
    assert {(r.source, r.heading, r.documents) for r in found.collect()} == {("s", "Share", 6), ("s", "More", 6)}
    known = spark.createDataFrame([("t", "Share")], "source string, heading string")
    out = {r.doc_id: r.text for r in templates.without_sections(docs, templates.with_known(found, known), "source").collect()}
    assert out[3] == "# Page 3\ntext 3\n## Own 3\nkept\n```\n## Share\n```\n" and out[9].count("Share") == 1 and len(out) == 7


def test_sitemaps_and_admission(spark):
    maps = spark.createDataFrame([("a.com", "https://a.com/s.xml", "<urlset><url><loc> https://a.com/x?a=1&amp;b=2 </loc></url><url><loc>https://b.com/</loc></url></urlset>"), ("a.com", "https://a.com/t.xml", "<sitemapindex><sitemap><loc>https://a.com/u.xml</loc></sitemap></sitemapindex>")], "site string, url string, body string")
    assert {tuple(r) for r in pages.sitemap_urls(maps).collect()} == {("a.com", "https://a.com/x?a=1&b=2", False), ("a.com", "https://b.com/", False), ("a.com", "https://a.com/u.xml", True)}
    links = spark.createDataFrame([("https://a.com/x", 1, False), ("https://www.a.com/y", 1, False), ("https://a.com/z", 1, True), ("https://b.com/", 1, False), ("https://a.com/deep", 3, False), ("https://a.com/old", 1, False)], "url string, depth int, nofollow boolean")
    got = pages.admitted(links, spark.createDataFrame([("https://a.com/old",)], "url string"), spark.createDataFrame([("a.com",)], "site string"), 2)
    assert {r.url for r in got.collect()} == {"https://a.com/x", "https://www.a.com/y"}


def test_an_index_is_searched_by_its_own_keys(spark, tmp_path):
    raw = spark.createDataFrame([("s", str(k), f"u{k}", f"Title {k}", f"# Head {k}\n" + f"word{k} common text about thing{k}. " * 90) for k in range(5)], RAW)
    built = index.build(raw, dim=64)
    built.write(str(tmp_path / "i"))
    got = index.read_index(spark, str(tmp_path / "i"))
    assert got.embeddings.first().fingerprint.endswith("d5")
    embedder = vectors.HashingEmbedder(64).fit(got.documents)
    embedder.write(str(tmp_path / "i"))
    again = vectors.HashingEmbedder.read(spark, str(tmp_path / "i"))
    assert again.fingerprint == embedder.fingerprint
    questions = spark.createDataFrame([(1, "word3 and thing3"), (2, "common text about thing1")], "q int, text string")
    lists = retrieval.arms(got.chunks, got.embeddings, questions, again.embed(questions, "q"), "q", 4)
    from lodestone.operators import ranking
    from lodestone.functions import text as T

    facts = ranking.question_facts(got.chunks.select(T.tokens(F.col("indexed_text")).alias("words")), questions, "q")
    out = retrieval.ranked(lists, got.chunks, facts, "q", retrieval.Settings(k=2)).join(got.documents.select("doc_id", "external_id"), "doc_id").orderBy("q", "rank").collect()
    assert [(r.q, r.rank) for r in out] == [(1, 1), (1, 2), (2, 1), (2, 2)] and out[0].external_id == "3" and out[2].external_id == "1"
    only = retrieval.arms(got.chunks, got.embeddings, questions, again.embed(questions, "q"), "q", 4, {"uri_prefix": "u2"})
    assert all(set(r.uri for r in only[a].join(got.chunks, "chunk_id").collect()) == {"u2"} for a in only)


def test_nearest_edge_cases(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", [0.0, 1.0])], "k string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "q int, vector array<double>")
    assert [tuple(r)[:2] for r in vectors.nearest(rows, asked, "k", "q", 2).orderBy("rank").collect()] == [(1, "a"), (1, "b")]
    none = vectors.nearest(rows, asked.where("q = 2"), "k", "q", 2)
    assert none.count() == 0 and none.columns == ["q", "k", "score", "rank"]


def test_many_queries_take_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "k long, vector array<double>").repartition(3)
    monkeypatch.setattr(vectors, "QUERY_BYTES", 8 * 4 * 20)
    got = vectors.nearest(df, df.select(F.col("k").alias("q"), "vector"), "k", "q", 3).orderBy("q", "rank").collect()
    s = np.round(m @ m.T, 6)
    assert [r.k for r in got] == [int(x) for i in range(60) for x in np.lexsort((np.arange(60), -s[i]))[:3]]


def test_stemmed_fields_against_brute_force(spark):
    import math
    import re

    texts = ["running in-process jobs runs", "the process ran in process", "jobs and a job; in", "nothing else here"]
    chunks = spark.createDataFrame([(k, t, f"Job {k}", "[s] running") for k, t in enumerate(texts)], "chunk_id int, text string, title string, context_header string")
    questions = spark.createDataFrame([(1, "in-process job"), (2, "runs")], "q int, text string")
    words = lambda t: [porter_stem(w) for w in re.findall(r"[a-z0-9]+", t.lower())]
    fields = [[(words(t), 1.0), (words(f"Job {k}"), 0.6), (words("[s] running"), 0.4)] for k, t in enumerate(texts)]
    size = [sum(len(w) for w, _ in f) for f in fields]
    want = Counter()
    for q, terms in ((1, ["in-process", "job"]), (2, ["runs"])):
        for t in terms:
            p = words(t)
            f = [sum(w * sum(ws[i : i + len(p)] == p for i in range(len(ws))) for ws, w in fs) for fs in fields]
            n = sum(x > 0 for x in f)
            idf = max(1e-6, math.log((4 - n + 0.5) / (n + 0.5)))
            for k, x in enumerate(f):
                if x:
                    want[q, k] += idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[k] / (sum(size) / 4)))
    got = {(r.q, r.chunk_id): r.score for r in lexical.field_bm25(chunks, questions, "chunk_id", "q").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
