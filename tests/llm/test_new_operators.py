"""Hard negatives, spelling variants and language spans against brute force, and what their docstrings state."""

from __future__ import annotations

import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives, language_spans, queries, spelling_variants

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parent.parent))
import compare  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_spelling_variants"])
def test_query_equals_its_sql(spark, name):
    assert compare.differences(queries.QUERIES[name](spark, SF), compare.connect(SF), queries.ORACLE_SQL[name]) == ([], [])


# 11 hard negatives


def mined_by_brute_force(rows):
    fine = []
    for place, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((place, i, [math.floor(256 * x) for x in v], label))
    out = Counter()
    last = lambda i: (i is None, i or 0)
    for a in fine:
        if a[1] is None or a[1] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), last(b[1]), b[0], b) for b in fine if b[0] != a[0]), key=lambda s: s[:3])
        for p in [s for s in scored if s[3][3] == a[3]][:5]:
            rest = [s for s in scored if s[3][3] != a[3] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:10]
            out.update((a[1], p[3][1], k, s[3][1], -p[0], -s[0]) for k, s in enumerate(rest, 1))
    return out


def vectors_fixture():
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(7)], rng.randrange(3)) for k in range(420)]
    rows += [(100, rows[5][1], 0), (100, rows[5][1], 0), (0, rows[0][1], rows[0][2]), (None, rows[1][1], 1)]  # ids again, a null id
    rows += [(500, None, 1), (501, [1.0, None], 1), (600, [float("nan")] * 7, 1), (700, [float("inf"), 1.0], 1), (800, [1.0] * 7, None)]
    rows += [(900, [0.5, 0.25], 2), (1000, [], 1), (1100, [0.5] * 40, 0)]  # of other lengths
    rows += [(2000 + k, [0.125] * 7, k % 2) for k in range(60)]  # ties
    return rows


@pytest.mark.parametrize("sizes", [(64, 4096, 32), (2, 16, 3)])
def test_hard_negatives(spark, sizes):
    rows = vectors_fixture()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).withColumn("id", F.lit("x")).withColumn("place", F.lit(0)).withColumn("q", F.lit("y"))
    got = hard_negatives.mined(df, F.col("vec_id") % 100 == 0, sizes=sizes)
    order = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    # equal scores of equal ids may stand for each other, so places are not compared
    assert Counter(tuple(r[c] for c in order) for r in got.collect()) == mined_by_brute_force(rows)


def test_more_anchors_than_are_broadcast(spark, monkeypatch):
    rows = vectors_fixture()
    monkeypatch.setattr(hard_negatives, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    got = hard_negatives.mined(df, F.col("vec_id") % 100 == 0, sizes=(2, 16, 3))
    assert sum(mined_by_brute_force(rows).values()) == got.count()


def test_no_anchors_and_large_vectors(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert hard_negatives.mined(spark.createDataFrame([], kind), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], kind), F.col("vec_id") % 100 == 0).count() == 0
    large = [(0, [3e5] * 4, 1), (1, [3e5 + 1] * 4, 1), (2, [2e5] * 4, 2)]
    assert Counter(tuple(r) for r in hard_negatives.mined(spark.createDataFrame(large, kind), F.col("vec_id") % 100 == 0).collect()) == mined_by_brute_force(large)
    with pytest.raises(ValueError):
        hard_negatives.mined(spark.createDataFrame([(0, [1e300], 1)], kind), F.col("vec_id") % 100 == 0)


def test_products_are_exact():
    a = np.array([[2**30, -(2**30) + 1, 3], [1, 2, 3]])
    assert hard_negatives.product(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in a] for r in a]


# 12 spelling variants


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def variants_by_brute_force(words: dict[str, int], times: int = 5):
    of = {w: [x for x in words if near(w, x)] for w in words}
    best = {w: min(of[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= times * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n, len(of[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def word_fixture(seed: int = 1, many: int = 500) -> dict[str, int]:
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(4, 8))): 5 ** rng.randrange(1, 9) for _ in range(many)}
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaab": 5**9, "x" * 5000: 7, "x" * 4999: 40, "y" * 64: 5, "y" * 65: 60, "z" + "é中" * 30: 9, "é中" * 30: 50}
    return words


@pytest.mark.parametrize(("shard", "pass_bytes"), [(1 << 15, 64 << 20), (50, 64 << 20), (7, 2000), (1, 64 << 20)])
def test_grouped_variants(spark, shard, pass_bytes):
    words = word_fixture() if shard > 1 else word_fixture(2, 60)
    df = spark.createDataFrame([*words.items()], "word string, n long").repartition(3)
    if pass_bytes == 2000:
        df = spark.createDataFrame([*itertools.islice(words.items(), 60), *list(words.items())[-10:]], "word string, n long").distinct()
        words = dict(df.collect())
    got = spelling_variants.grouped_variants(df, shard_words=shard, pass_bytes=pass_bytes)
    assert Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()) == variants_by_brute_force(words)


def test_trie_in_small_blocks_of_states(monkeypatch):
    monkeypatch.setattr(spelling_variants, "STATES", 3)
    words = sorted(word_fixture(5, 300))
    words = [w for w in words if len(w) < 20]
    trie = spelling_variants.Trie(**spelling_variants.Trie.built(words, [1] * len(words)))
    table, size = spelling_variants.code_table(words)
    q, w = spelling_variants.neighbours(table, size, trie)
    got = Counter(zip(q.tolist(), w.tolist(), strict=True))
    assert got == Counter((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b))


def counted_by_brute_force(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def test_spelling_variants_of_documents(spark):
    rng = random.Random(9)
    letters = ["ab", "Éc", "dÿ", "×é", "Ab"]
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(80)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=300))) for k in range(40)]
    rows += [(None, None), (50, None), (51, ""), (None, "nobody " * 9), (52, "12 34"), rows[0], (53, "q" * 200_000 + " "), (54, "İstanbul straße " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("id", F.lit(1)).withColumn("run", F.lit(2)).repartition(3)
    got = spelling_variants.spelling_variants(df)
    assert Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()) == variants_by_brute_force(counted_by_brute_force(rows))
    assert spelling_variants.spelling_variants(df.limit(0)).count() == 0


# 13 language spans


def plain_viterbi(scores, fresh, switching):
    n, m = scores.shape
    v, back = np.zeros(m), []
    for t in range(n):
        cost = 0.0 if fresh[t] else switching
        best = int(v.argmax())
        stay = v >= v[best] - cost
        back.append(np.where(stay, np.arange(m), best))
        v = np.maximum(v, v[best] - cost) + scores[t]
    return v.max()


def worth(path, scores, fresh, switching):
    return sum(scores[t, k] - (0.0 if t == 0 or fresh[t] or path[t - 1] == k else switching) for t, k in enumerate(path.tolist()))


@pytest.mark.parametrize(("n", "m", "chunks"), [(1, 3, 4), (7, 2, 3), (500, 4, 8), (500, 4, 1), (333, 6, 2048), (64, 3, 64)])
def test_viterbi_in_chunks(n, m, chunks):
    rng = np.random.default_rng(n + m)
    scores, fresh = -rng.integers(0, 9, (n, m)).astype(float), rng.random(n) < 0.05
    fresh[0] = True
    path = language_spans.viterbi(scores, fresh, 3.0, chunks)
    assert len(path) == n and worth(path, scores, fresh, 3.0) == pytest.approx(plain_viterbi(scores, fresh, 3.0))


def words_by_brute_force(text):
    script, letter, _ = language_spans.code_points()
    out, at = [], 0
    while at < len(text):
        k = int(script[ord(text[at])])
        end = at + 1
        while k and end < len(text) and script[ord(text[end])] == k:
            end += 1
        if k and any(letter[ord(c)] for c in text[at:end]):
            out.append((at, end, k, sum(bool(letter[ord(c)]) for c in text[at:end])))
        at = end
    return out


def test_words_of_texts():
    texts = ["One two, three.", "", "Привет world 中文字 かな", "ábc ́ 12", "\U0001f600 x", "नमस्ते दुनिया", "tail"]
    w = language_spans.words_of(texts)
    got = [(int(t), int(a), int(b), int(k), int(n)) for t, a, b, k, n in zip(w.text, w.start, w.end, w.script, w.letters, strict=True)]
    assert got == [(i, *x) for i, t in enumerate(texts) for x in words_by_brute_force(t)]


@pytest.fixture(scope="module")
def model(spark):
    docs = queries.table(spark, SF, "documents")
    return language_spans.fitted(docs.where(~language_spans.is_held_out()).select("text", "lang"))


def test_held_out_accuracy(spark, model):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = queries.op13_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)


def test_counts_are_those_of_the_texts(spark):
    rows = [("ab ab", "x"), ("AB", "x"), ("Ж", "y"), (None, "x"), ("zz", None)]
    model = language_spans.fitted(spark.createDataFrame(rows, "text string, lang string"))
    w = language_spans.words_of(["ab"])
    # three words "ab" of two trigrams each
    assert model.languages == ["x", "y"] and np.allclose(np.exp(model.table[0][w.bucket]), 4 / (6 + language_spans.BUCKETS))
    assert [model.writes[k].tolist() for k in (1, 3)] == [[True, False], [False, True]]


def test_spans_of_mixed_text(spark, model):
    german, spanish = "und der die ist nicht mit einer eine schreiben werden und auch ist der", "que de los para con una las por como ción mente y que en la"
    got = {r.doc_id: r for r in language_spans.identified(spark.createDataFrame([(1, german + ". " + spanish), (2, german), (3, None), (4, "12 !!"), (5, "Привет мир"), (None, spanish)], "doc_id long, text string"), model, with_spans=True).collect()}
    assert [s.lang for s in got[1].spans] == ["de", "es"] and abs(got[1].spans[1].start - len(german)) <= 12 and got[1].n_spans == 2
    assert got[2].lang_pred == "de" and got[2].score == 1.0 and got[2].spans[0].asDict() == {"start": 0, "end": len(german), "lang": "de"}
    assert [(got[k].lang_pred, got[k].score, got[k].spans) for k in (3, 4)] == [("und", 0.0, [])] * 2
    assert got[5].lang_pred in model.languages and got[None].lang_pred == "es"


def test_nothing_learned_and_empty_tables(spark):
    none = language_spans.fitted(spark.createDataFrame([("a", None)], "text string, lang string"))
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("score", F.lit(2))
    assert [tuple(r) for r in language_spans.identified(d, none).collect()] == [(1, "und", 0.0, 0)]
    assert language_spans.identified(d.limit(0), none).count() == 0
    one = language_spans.fitted(d.select("text", "lang"))
    long = "word " * 300_000
    assert [tuple(r) for r in language_spans.identified(spark.createDataFrame([(1, long)], "doc_id long, text string"), one).collect()] == [(1, "en", 1.0, 1)]
