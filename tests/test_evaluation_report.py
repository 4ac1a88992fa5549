"""The evaluation report makes its documents' tokens and its search once, for metrics and answers."""

from lodestone.operators import lexical
from lodestone.plans import search


def test_one_search_for_metrics_and_answers(spark, sf, monkeypatch):
    made = []
    bm25, tokens = lexical.bm25, search._tokens
    monkeypatch.setattr(lexical, "bm25", lambda *a, **k: made.append("bm25") or bm25(*a, **k))
    monkeypatch.setattr(search, "_tokens", lambda *a: made.append("tokens") or tokens(*a))
    assert search.evaluation_report(spark, sf).count() == 1
    assert sorted(made) == ["bm25", "tokens"]
    eight = sorted(tuple(r) for r in search.candidates(spark, sf, 8).select("item_id", "doc_id", "rank").collect())
    ranked = search._ranked(spark, sf)
    assert sorted(tuple(r) for r in search.candidates(spark, sf, 8, ranked=ranked).select("item_id", "doc_id", "rank").collect()) == eight
