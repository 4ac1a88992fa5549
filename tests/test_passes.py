"""What is done once for all that reads it, and what does not go over the whole corpus."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import lexical, ranking, vectors


def _dealt(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    return spark.createDataFrame([(k, f"river {'stone ' * (k % 3)}lake{k}") for k in range(40)], "doc_id long, text string")


def test_matches_are_dealt_once_for_frequencies_and_scores(spark):
    asked = spark.createDataFrame([(0, "stone river"), (1, "lake3")], "item_id long, text string")
    assert "ReusedExchange" in _dealt(lexical.bm25(_docs(spark), asked, "doc_id", "item_id"))


def test_only_distinct_words_are_stemmed(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counting(words):
        seen.add(len(words))
        return words

    monkeypatch.setattr(T, "stem", counting)
    asked = spark.createDataFrame([(0, "stone river")], "item_id long, text string")
    found = lexical.field_bm25(_docs(spark), asked, "doc_id", "item_id", {"text": 1.0})
    assert len(found.collect()) == 40
    # 42 distinct words and the questions' two, once or twice, of 119
    assert seen.value <= 2 * 44


def test_no_more_words_are_read_than_tell_a_large_corpus(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    many = spark.range(0, 200_000, 1, 1).select(F.concat(F.lit("w"), "id").alias("term")).mapInArrow(counting, "term string")
    assert ranking._many_words(many, 100) and seen.value < 200_000
    # few words among the first ones do not tell: then all count
    late = spark.range(0, 5000, 1, 1).select(F.when(F.col("id") < 4000, "a").otherwise(F.col("id").cast("string")).alias("term"))
    assert ranking._many_words(late, 100) and not ranking._many_words(late, 1002)


def test_each_distinct_ngram_is_hashed_once(monkeypatch):
    words = ["abcdefgh" * 3 + x for x in "pqrst"] + ["ab", "日本語テキスト"]
    want = [[(vectors._place(w, "w", 64)), *(vectors._place(g, "g", 64) for g in ([f"^{w}$"] if len(w) <= 4 else [f"^{w}$"[i : i + 4] for i in range(len(w) - 1)]))] for w in words]
    hashed, place = [], vectors._place
    monkeypatch.setattr(vectors, "_place", lambda f, salt, dim: hashed.append((f, salt)) or place(f, salt, dim))
    size, at, value = vectors._features(words, 64, 4)
    assert len(hashed) == len(set(hashed))
    flat = [p for w in want for p in w]
    assert size.tolist() == [len(w) for w in want] and at.tolist() == [p[0] for p in flat]
    assert np.allclose(value, [p[1] * (1.0 if k == 0 else vectors.GRAM_WEIGHT) for w in want for k, p in enumerate(w)])


def test_rows_of_one_key_and_without_words_have_vectors_each(spark):
    docs = spark.createDataFrame([(1, "stone lake"), (1, "river"), (2, None), (None, "stone"), (3, "stone lake river")], "doc_id long, text string")
    terms = spark.createDataFrame([("stone", 0.5)], "term string, idf double")
    made = vectors.embed(docs, terms, "doc_id")
    got = [(r.doc_id, np.array(r.vector)) for r in made.collect()]
    assert sorted((k is not None, k or 0) for k, _ in got) == [(False, 0), (True, 1), (True, 1), (True, 2), (True, 3)]
    full = [v for k, v in got if k in (1, 3)]
    assert all(np.allclose(v, full[0]) for v in full) and not any(v.any() for k, v in got if k in (None, 2))
