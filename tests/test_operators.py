import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, chunking, evaluation, incremental, ranking, templates, vectors
from lodestone.operators.filters import matching


def test_chunks_of_each_kind(spark):
    code = "import os\n\ndef first(a):\n" + "    x = a + 1\n" * 60 + "\nclass Second:\n" + "    y = 2\n" * 60
    rows = [("p", "fs", "u", "T", "# H\n" + "Some words here. " * 400, "prose", None), ("c", "fs", "u", "f.py", code, "code", "python"), ("t", "youtube", "https://youtu.be/x", "V", "\n".join(f"[0:{k:02d}] cue {k} " + "w " * 30 for k in range(40)), "transcript", None),
            ("h", "chat", "u", "S", "\n".join(f"{'user' if k % 2 else 'assistant'}: turn {k} " + "w " * 60 for k in range(20)), "chat", None), ("n", "fs", "u", "N", None, "prose", None)]
    got = chunking.chunked(spark.createDataFrame(rows, "doc_id string, source_system string, uri string, title string, text string, kind string, language string")).collect()
    by = {k: sorted((r for r in got if r.doc_id == k), key=lambda r: r.ordinal) for k in "pcthn"}
    assert not by["n"] and all(by[k] for k in "pcth")
    assert all([r.ordinal for r in v] == list(range(len(v))) for v in by.values())
    assert by["p"][0].context_header == "[fs] T | H" and [r.metadata.get("symbol") for r in by["c"]] == ["first", "Second"] and by["c"][0].text.startswith("import os")
    assert by["t"][1].metadata["deep_link"].startswith("https://youtu.be/x?t=") and by["h"][0].metadata["role"] == "assistant"


def test_longest_run_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [str(v) for v in rng.integers(0, 4, rng.integers(0, 9))], [str(v) for v in rng.integers(0, 4, rng.integers(0, 30))]) for k in range(80)]
    df = spark.createDataFrame(rows, "k int, q array<string>, t array<string>")
    got = {r.k: r.n for r in df.select("k", ranking.longest_run(F.col("q"), F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" "))).alias("n")).collect()}
    for k, q, t in rows:
        best = max((n for i in range(len(q)) for n in range(2, len(q) - i + 1) if any(t[j : j + n] == q[i : i + n] for j in range(len(t)))), default=0)
        assert got[k] == best


def test_mmr_prefers_what_differs(spark):
    rows = [(1, "a", 1.0, ["x", "y"]), (1, "b", 0.9, ["x", "y"]), (1, "c", 0.8, ["z"]), (2, "d", 0.1, [])]
    got = ranking.mmr(spark.createDataFrame(rows, "q int, d string, score double, words array<string>"), "q", "d", k=2).orderBy("q", "pick").collect()
    assert [r.d for r in got] == ["a", "c", "d"]


def test_fusion_keeps_arms_of_weight_zero(spark):
    a, b = spark.createDataFrame([(1, 10, 1)], "q int, d int, rank int"), spark.createDataFrame([(1, 20, 1), (1, 10, 2)], "q int, d int, rank int")
    got = {r.d: r.score for r in ranking.fuse({"a": a, "b": b}, "q", "d", weights={"b": 0.0}).collect()}
    assert got[20] == 0.0 and math.isclose(got[10], 1 / 61)


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "k long, vector array<double>").repartition(5)
    got = vectors.nearest(df, df.where("k < 7").select(F.col("k").alias("q"), "vector"), "k", "q", 5).orderBy("q", "rank").collect()
    s = np.round(m[:7] @ m.T, 6)
    assert [r.k for r in got] == [int(x) for i in range(7) for x in np.lexsort((np.arange(300), -s[i]))[:5]]


def test_embeddings_have_unit_norm(spark):
    d = spark.createDataFrame([(1, "chunking text chunked"), (2, None), (3, "chunking text chunked")], "doc_id long, text string")
    got = {r.doc_id: np.array(r.vector) for r in vectors.embed(d, spark.createDataFrame([("text", 0.5)], "term string, idf double"), "doc_id").collect()}
    assert np.isclose(np.linalg.norm(got[1]), 1, atol=1e-5) and not got[2].any() and (got[1] == got[3]).all()


def test_delta_and_upsert(spark):
    kind = "s string, i int, content_hash string"
    a, b = spark.createDataFrame([("x", 1, "h"), ("x", 2, "h"), ("x", 3, None)], kind), spark.createDataFrame([("x", 1, "h"), ("x", 2, "g"), ("x", 4, "h")], kind)
    assert {(r.i, r.status) for r in incremental.delta(a, b, ["s", "i"]).collect()} == {(1, "unchanged"), (2, "changed"), (3, "removed"), (4, "new")}
    assert {(r.i, r.content_hash) for r in incremental.upsert(a, b, ["i"]).collect()} == {(1, "h"), (2, "g"), (3, None), (4, "h")}
    failed = incremental.delta_counts(incremental.delta(a, b, ["s", "i"]), "s", F.col("i") == 2).first()
    assert (failed.removed, failed.failed) == (0, 1)


def test_rules(spark):
    one = spark.createDataFrame([(0.5, False, 0.9, 0.95, 0.0, None, True, 10), (1.0, False, 0.9, 0.9, 0.1, None, False, 10)], "coverage double, fingerprint_mismatch boolean, pass_rate double, previous_pass_rate double, growth double, degradation string, content_changed boolean, documents int")
    got = sorted((r.coverage, r.priority, r.kind) for r in incremental.corpus_actions(one).collect())
    assert got == [(0.5, 30, "run_eval"), (0.5, 100, "embed_missing"), (1.0, 0, "noop")]
    assert incremental.needs_refit(10, 1, None, None) and incremental.needs_refit(13, 10, 10, 10) and not incremental.needs_refit(12, 12, 10, 10) and incremental.needs_refit(10, 7, 10, 10)


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", "X/1", 5.0, '{"k": "v"}'), (2, "b", "x/2", None, None)], "doc_id int, source_system string, uri string, updated_at double, metadata string")
    ids = lambda f: [r.doc_id for r in df.where(matching(f, metadata=("metadata",))).collect()]
    assert ids({}) == [1, 2] and ids({"doc_ids": []}) == [] and ids({"exclude_doc_ids": []}) == [1, 2] and ids({"uri_prefix": "x/"}) == [1, 2] and ids({"updated_after": 5.0}) == [1] and ids({"k": "v"}) == [1] and ids({"exclude_source": ["a"]}) == [2]


def test_templates(spark):
    d = spark.createDataFrame([(k, "s", f"Menu\nbody {k}\nFooter") for k in range(6)] + [(9, "t", "Menu\nx")], "doc_id int, source string, text string")
    t = templates.learned(d, "source", "doc_id", F.split("text", "\n"))
    assert {r.line for r in t.collect()} == {"Menu", "Footer"}
    assert {r.text for r in templates.stripped(d, t, "source").collect()} == {*(f"body {k}" for k in range(6)), "Menu\nx"}


def checked(spark, rows):
    df = spark.createDataFrame([*enumerate(rows)], "k int, row struct<a: string, m: array<int>>").select("k", answers.verify(F.col("row.a"), F.col("row.m")).alias("v"))
    return [(r.v.used, r.v.invalid, r.v.coverage, r.v.text) for r in sorted(df.collect())]


def test_citations_are_checked(spark):
    rows = [
        (("This is a claim with words [1]. Another claim made of words [7].", [1]), ([1], [7], 0.5, "This is a claim with words [1]. Another claim made of words .")),
        (("This claim is long enough. [1]", [1]), ([1], [], 1.0, "This claim is long enough. [1]")),
        (("", [1]), ([], [], 0.0, "")),
        ((None, None), ([], [], 0.0, "")),
        (("Too short.", None), ([], [], 1.0, "Too short.")),
        (("A long claim stands right here [2][3] and array[4] too (x)[5].", [2]), ([2], [], 1.0, "A long claim stands right here [2][3] and array[4] too (x)[5].")),
        (("Before it goes [9] on.\n\n```\nx = [9]\n```\n\nAfter it goes [9] on [01].", [1]), ([1], [9], 1.0, "Before it goes on.\n\n```\nx = [9]\n```\n\nAfter it goes on [01].")),
        (("~~~a [1]~~~ [99999999999] then  more  words follow here", [1]), ([], [], 1.0, "~~~a [1]~~~ then more words follow here")),
        (("- a list item of many words\n\n3. another item of many words\n\nOne claim of five words [2]", [2]), ([2], [], 1.0, "- a list item of many words\n\n3. another item of many words\n\nOne claim of five words [2]")),
    ]
    assert checked(spark, [r[0] for r in rows]) == [r[1] for r in rows]


def test_citations_against_a_loop(spark):
    """Random answers, checked word by word."""
    import random

    rng, rows = random.Random(2), []
    for _ in range(150):
        said = [f"{'Aa' if rng.random() < 0.9 else '*'} " + " ".join(rng.choice(["bb", "cc", "[1]", "[2]", "[5]", "x[1]"]) for _ in range(rng.randrange(2, 9))) + rng.choice([".", "!", ". [1]", ". [6]"]) for _ in range(rng.randrange(5))]
        rows.append(("\n\n".join(said), [1, 2, 3]))

    def by_hand(text, known):
        words = text.replace("\n\n", " ").split()
        marks = list(dict.fromkeys(int(w.strip("[].!")) for w in words if w.startswith("[")))
        kept = [[w for w in p.split() if not (w.startswith("[") and int(w.strip("[].!")) not in known and not w.endswith((".", "!")))] for p in text.split("\n\n") if p]
        kept = [[("." if w.endswith(".") else "!") if w.startswith("[") and int(w.strip("[].!")) not in known else w for w in p] for p in kept]
        said = [p for p in kept if len(p) >= 5 and p[0] != "*"]
        # a marker after the full stop counts as a word of its sentence
        cited = sum(any(w.startswith("[") for w in p) for p in said)
        return [m for m in marks if m in known], [m for m in marks if m not in known], round(cited / len(said), 4) if said else float(bool(kept))

    got = checked(spark, rows)
    assert [g[:3] for g in got] == [by_hand(*r) for r in rows]


def test_extractive_answers(spark):
    rows = [(1, 1, "Spark joins tables well on keys. Bread is baked in ovens daily. Import spark, joins = tables(x);", 0.9, ["joins", "spark"], [1.0, 2.0]), (2, 1, "Nothing here matches at all. Second sentence follows it. Third.", 0.5, ["zebra"], [1.0])]
    got = {r.q: r.answer for r in answers.extractive(spark.createDataFrame(rows, "q int, marker int, text string, score double, asked array<string>, idfs array<double>"), "q").collect()}
    assert got[1].startswith("Spark joins tables well on keys [1].") and "Bread" not in got[1]
    assert got[2] == "Nothing here matches at all. Second sentence follows it [1]."


def test_auc_and_floors(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "s double, p boolean")
    assert evaluation.auc(df, "s", "p").first().auc == 0.875
    assert {(r.floor, r.errors) for r in evaluation.floors(df, "s", "p").collect()} == {(0.1, 2), (0.4, 1), (0.9, 1)}


def test_contamination_finds_changed_and_repetitive_passages(spark):
    from lodestone.functions import text as T

    words = [f"word{chr(97 + k)}" for k in range(20)]
    chant = " ".join(["hum"] * 36 + ["alpha", "beta", "gamma", "delta"])
    docs = [(0, " ".join(["start", *words[:18], "other", "end"])), (1, " ".join(words[::-1])), (2, " ".join(words[:10])), (3, " ".join(["hum"] * 36)), (4, "hum alpha words of no passage")]
    asked = [(0, " ".join(words)), (1, chant), (2, "beta unseenterm")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    got = {(r.item_id, r.doc_id): (r.kind, r.score) for r in evaluation.contamination(d, q, "doc_id", "item_id", T.tokens).collect()}
    assert got == {(0, 0): ("verbatim", 0.9), (0, 1): ("overlap", 1.0), (1, 3): ("verbatim", 0.9)}
    # of "alpha unseenterm", a document with alpha alone has a small share of the weight
    few = spark.createDataFrame([(0, "alpha unseenterm")], "item_id long, text string")
    assert evaluation.contamination(d, few, "doc_id", "item_id", T.tokens).count() == 0


def test_floors_round_numbers_as_they_are(spark):
    """0.285 is stored below the middle of 0.28 and 0.29, as SQL's round sees it; 0.375 is the middle itself."""
    rows = [(0.285, True), (0.29, False), (0.375, True), (0.28, False)]
    got = {r.floor: (r.refused_positives, r.answered_negatives) for r in evaluation.floors(spark.createDataFrame(rows, "s double, good boolean"), "s", "good").collect()}
    assert got == {0.28: (0, 2), 0.29: (1, 1), 0.38: (1, 0)}


def test_lightest_runs_and_contamination_by_brute_force(spark):
    """What the candidates' bound says of each question, and what is found, with words that repeat and negative questions."""
    import random

    from lodestone.functions import text as T

    pick = random.Random(5)
    words = [f"w{chr(97 + k // 5)}{chr(97 + k % 5)}" for k in range(25)]
    asked = [(k, [pick.choice(words) for _ in range(pick.choice([1, 2, 5, 12, 20]))], k % 2 == 0) for k in range(12)]
    docs = []
    for k in range(60):
        of = pick.choice(asked)[1]
        at = pick.randrange(len(of))
        docs.append((k, [pick.choice(words) for _ in range(pick.randrange(6))] + of[at : at + pick.randrange(len(of) + 1)] + [pick.choice(words) for _ in range(pick.randrange(6))]))
    weights = {w: round(math.log(1 + (60 - c + 0.5) / (c + 0.5)), 4) for w in words for c in [sum(w in d for _, d in docs)]}
    q = spark.createDataFrame([(k, " ".join(s), n) for k, s, n in asked], "item_id long, text string, negative boolean")
    sides = q.select("item_id", T.tokens(F.col("text")).alias("_sequence"), F.when(F.col("negative"), 0.5).otherwise(0.85).alias("_run_floor"))
    idf = spark.createDataFrame([(k, w, weights[w]) for k, s, _ in asked for w in set(s)], "item_id long, term string, idf double")
    got = {r.item_id: r._lightest for r in evaluation._lightest_runs(sides, idf, "item_id").collect()}
    need = {k: max(1, math.ceil(len(s) * (0.5 if n else 0.85) - 1e-9)) for k, s, n in asked}
    assert got == pytest.approx({k: min(sum(weights[w] for w in set(s[a : a + need[k]])) for a in range(len(s) - need[k] + 1)) for k, s, _ in asked})

    def found(s, d, negative):
        runs = [j - i for i in range(len(s)) for j in range(i + 2, len(s) + 1) if f" {' '.join(s[i:j])} " in f" {' '.join(d)} "]
        run, share = max(runs, default=0) / len(s), sum(weights[w] for w in set(s) & set(d)) / sum(weights[w] for w in set(s))
        return ("verbatim", round(run, 5)) if run >= (0.5 if negative else 0.85) else ("overlap", round(share, 5)) if share >= (0.6 if negative else 0.9) else None

    want = {(k, i): f for k, s, n in asked for i, d in docs if (f := found(s, d, n))}
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string")
    rows = evaluation.contamination(table, q, "doc_id", "item_id", T.tokens, negative="negative").collect()
    assert {(r.item_id, r.doc_id): (r.kind, round(r.score, 5)) for r in rows} == want and len(rows) == len(want) > 50


def test_a_text_is_made_once_for_its_longest_run(spark):
    """Inside the step over words a Python function could not stand, since it would be called for each of them."""
    said = F.udf(lambda t: f" {t} ", "string")
    one = spark.createDataFrame([("a b c d x".split(), "q b c d y a b")], "asked array<string>, t string")
    assert one.select(ranking.longest_run(F.col("asked"), said("t")).alias("n")).first().n == 3


def test_tasks_grow_with_the_input(spark, monkeypatch):
    """A task cuts or adds up so much at any size of the input; results are the same."""
    from lodestone.operators import lexical

    docs = spark.createDataFrame([(str(k), "fs", "u", "T", f"Some words here, {k} of them. " * 300, "prose", None) for k in range(12)], "doc_id string, source_system string, uri string, title string, text string, kind string, language string")
    asked = spark.createDataFrame([(0, "words 7")], "item_id long, text string")

    def both():
        chunks = chunking.chunked(docs)
        found = lexical.field_bm25(chunks, asked, "chunk_id", "item_id", stems=False)
        return chunks, found, sorted(map(tuple, chunks.select("chunk_id", "text").collect())), sorted((r[1], round(r[2], 9)) for r in found.collect())

    few = both()
    monkeypatch.setattr(chunking, "TASK_CHARACTERS", 1000)
    monkeypatch.setattr(lexical, "TASK_ROWS", 1)
    many = both()
    assert few[2:] == many[2:] and few[3]
    characters = sum(len(r.text) for r in docs.collect())
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in many[:2]]
    assert f", {-(-characters // 1000)}" in plans[0].split("RepartitionByExpression")[1].split("\n")[0]
    assert f", {len(many[2])}" in plans[1].split("RepartitionByExpression")[1].split("\n")[0]


def test_trimming_takes_what_the_pattern_took(spark):
    white = "".join(c for c in map(chr, range(0x3001)) if c.isspace() or c in "\x85\xa0")
    rows = spark.createDataFrame([(f"{w}a{w} b{w}{w}",) for w in [*white, "​", "x", "", "\n \t"]], "t string")
    assert rows.where((chunking.stripped(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")) | (chunking._indent(F.col("t")) != F.length("t") - F.length(F.regexp_replace("t", r"(?U)^\s+", "")))).count() == 0
