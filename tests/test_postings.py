"""A kept inverted index: searches equal those over the texts, removals are exact, blocks are skipped, folders are pruned."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, postings

rng = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "in-process", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, " ".join(rng.choices(WORDS, weights=range(1, 12), k=rng.randrange(1, 60)))) for k in range(900)]
    rows += [(1000 + k, "omega sigma " * (3 + k)) for k in range(12)] + [(2000, ""), (2001, None), (None, "omega")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "alpha beta"), (2, "omega sigma kappa"), (3, "in-process zeta"), (4, "nothing here"), (5, "the"), (6, "gamma")], "item_id int, text string")


def over_texts(docs, asked, k=5):
    return sorted(tuple(r) for r in lexical.top(lexical.bm25(docs.where("doc_id is not null"), asked, "doc_id", "item_id"), ["item_id"], k, "doc_id").select("item_id", "doc_id", "score", "rank").collect())


def from_index(index, asked, k=5, **settings):
    return sorted(tuple(r) for r in index.search(asked, "item_id", k, **settings).select("item_id", "key", "score", "rank").collect())


def test_search_removal_and_compaction(spark, docs, asked, tmp_path):
    index = postings.Postings(spark, str(tmp_path / "index"))
    assert index.put(docs, "doc_id") == 1
    read: list = []
    assert from_index(index, asked, read=read) == over_texts(docs, asked)
    windows, scored = read[0]
    assert 0 < scored < windows  # most windows cannot hold one of the best
    assert index.totals()[0] == 914

    index.remove(docs.where("doc_id % 3 = 0 or doc_id = 1001"), "doc_id")
    left = docs.where("doc_id % 3 <> 0 and doc_id <> 1001")
    assert from_index(index, asked) == over_texts(left, asked)

    changed = docs.where("doc_id between 10 and 40").withColumn("text", F.lit("omega gamma"))
    index.put(changed, "doc_id")
    now = left.where("doc_id not between 10 and 40").unionByName(changed)
    assert from_index(index, asked) == over_texts(now, asked)
    frequencies = {r.term: r.df for r in index.frequencies().collect()}
    assert frequencies == {r.term: r.df for r in now.select(F.explode(F.array_distinct(lexical.T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}

    # another reader of the same folder, and the compacted index
    again = postings.Postings(spark, str(tmp_path / "index"))
    assert again.version == 3
    again.compact()
    assert again.segments() == [4] and from_index(again, asked) == over_texts(now, asked) and index.segments() == [4]


def test_another_analysis_is_refused(spark, docs, tmp_path):
    postings.Postings(spark, str(tmp_path / "index")).put(docs.limit(5), "doc_id")
    for other in (postings.Analysis(phrases=True), postings.Analysis(stems=True), postings.Analysis({"text": 2.0})):
        with pytest.raises(ValueError):
            postings.Postings(spark, str(tmp_path / "index"), other)
    with pytest.raises(ValueError):
        postings.Postings(spark, str(tmp_path / "none")).frequencies()


def test_an_unfinished_segment_does_not_count(spark, docs, asked, tmp_path):
    index = postings.Postings(spark, str(tmp_path / "index"))
    index.put(docs.where("doc_id < 500"), "doc_id")
    index.put(docs.where("doc_id >= 500"), "doc_id")
    (tmp_path / "index/totals/segment=00000002/_SUCCESS").unlink()
    assert from_index(postings.Postings(spark, str(tmp_path / "index")), asked) == over_texts(docs.where("doc_id < 500"), asked)


def test_only_folders_of_asked_terms_are_read(spark, docs, tmp_path):
    index = postings.Postings(spark, str(tmp_path / "index"))
    index.put(docs, "doc_id")
    plan = index.frequencies(spark.createDataFrame([("gamma",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "folder" in plan.split("PartitionFilters")[1][:200]


def test_phrases_and_stems(spark, tmp_path):
    docs = spark.createDataFrame([(1, "in process work", "t"), (2, "process in", "in-process"), (3, "works, in an process", "x")], "doc_id long, text string, title string")
    asked = spark.createDataFrame([(1, "in-process"), (2, "working")], "item_id int, text string")
    for stems in (False, True):
        index = postings.Postings(spark, str(tmp_path / f"index{stems}"), postings.Analysis({"text": 1.0, "title": 0.5}, phrases=True, stems=stems))
        index.put(docs, "doc_id")
        want = lexical.top(lexical.field_bm25(docs, asked, "doc_id", "item_id", {"text": 1.0, "title": 0.5}, stems=stems), ["item_id"], 3, "doc_id").select("item_id", "doc_id", "score", "rank")
        assert from_index(index, asked, 3, k1=1.2, positive=False) == sorted(tuple(r) for r in want.collect())


def test_blocks_are_few_and_whole(spark, docs, tmp_path):
    index = postings.Postings(spark, str(tmp_path / "index"))
    index.put(docs, "doc_id")
    blocks = index._every("blocks")
    # a row for each term and task of the four, not for each term and each of the fifteen windows
    assert blocks.count() <= 4 * blocks.select("term").distinct().count()
    ends = blocks.select(F.size("keys").alias("n"), F.element_at("ends", -1).alias("last"), F.size("ws").alias("w"), F.size("ends").alias("e"), F.size("f").alias("f"))
    assert ends.where("n <> last or w <> e or n <> f").count() == 0
    each = index._by_window(blocks, ["keys"]).select("w", F.explode("keys").alias("key"))
    assert each.where(F.col("w") != postings._window_of("key", F.lit(-(-914 // postings.WINDOW)))).count() == 0
    assert each.count() == blocks.agg(F.sum(F.size("keys"))).first()[0] == index.frequencies().agg(F.sum("df")).first()[0]
