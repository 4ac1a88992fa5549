from pyspark.sql import functions as F

from lodestone.operators import index

KIND = "source_system string, external_id string, uri string, title string, text string"


def test_index_is_built_pruned_and_completed(spark, tmp_path):
    raw = spark.createDataFrame([("s", str(k), f"u{k}", f"Title {k}", f"# Head {k}\n" + f"word{k} common text. " * 80) for k in range(4)], KIND)
    built = index.build(raw, dim=64)
    built.write(str(tmp_path / "i"))
    got = index.read_index(spark, str(tmp_path / "i"))
    mark = got.embeddings.first().fingerprint
    assert got.documents.count() == 4 and got.chunks.count() == got.embeddings.count() > 0
    assert index.missing_vectors(got.chunks, got.embeddings, mark).count() == 0
    assert index.missing_vectors(got.chunks, got.embeddings, "other").count() == got.chunks.count()
    gone = got.documents.limit(1).select("doc_id")
    less = index.without_documents(got, gone)
    assert less.documents.count() == 3 and less.chunks.join(less.embeddings, "chunk_id", "left_anti").count() == 0
    assert index.embed_missing(index.Index(got.documents, got.chunks, got.terms, less.embeddings), mark, 64).count() == got.chunks.count()
    assert index.stale_cursor(raw.select("source_system", "external_id"), less.documents).count() == 1


def test_journal_and_failures(spark, tmp_path):
    for k in range(3):
        index.append_journal(spark, str(tmp_path / "j"), k // 2, "observe", {"n": k})
    assert [r.payload for r in index.read_journal(spark, str(tmp_path / "j"), limit=1).collect()] == ['{"n": 2}']
    assert [r.payload for r in index.read_journal(spark, str(tmp_path / "j"), cycle=0).collect()] == ['{"n": 0}', '{"n": 1}']
    rows = [(1, True, False, False, None), (2, False, False, True, None), (3, False, False, True, 30), (4, False, False, True, 9), (5, False, True, True, 1), (6, False, False, False, 1), (7, False, False, True, 1)]
    df = spark.createDataFrame(rows, "q int, expect_abstain boolean, abstained boolean, answered_right boolean, rank int")
    assert [r.failure for r in index.case_failures(df, "q").orderBy("q").collect()] == ["false_answer", "unreachable", "candidate", "ranking", "abstention", "answer", None]
    lines = spark.createDataFrame([(1, 0, "x"), (1, 1, "# A"), (1, 2, "y")], "k int, n int, line string")
    assert [r.heading for r in index.nearest_heading(lines, "k").orderBy("n").collect()] == [None, "A", "A"]
    assert lines.select(F.max("n")).first()[0] == 2
