"""Queries on search, ranking and evaluation: every benchmark passage is a question over all documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import evaluation, lexical, postings, ranking, retrieval, statistics, vectors
from ..operators.chunking import chunked
from ..operators.staging import shared_folder, small_side, staged
from .tables import sql_tokens, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
K = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _tokens(spark, sf):
    """The documents' tokens, made once for all that a query does with them."""
    return staged(table(spark, sf, "documents").select("doc_id", "source", T.tokens(F.col("text")).alias("words")), "tokens")


def _as_they_are(words):
    return words


def _ranked(spark, sf, k=K, tokens=None, **settings):
    words = _tokens(spark, sf) if tokens is None else tokens
    found = lexical.bm25(words, table(spark, sf, "benchmark"), "doc_id", "item_id", "words", words=_as_they_are, question_words=T.tokens, **settings)
    return lexical.top(found, ["item_id"], k, "doc_id")


def _sql_bm25(k: int, k1: float = 1.5, b: float = 0.75, name: str = "ranked", positive: bool = True) -> str:
    weight = "ln(1 + (n - df + 0.5) / (df + 0.5))" if positive else "greatest(1e-6, ln((n - df + 0.5) / (df + 0.5)))"
    return f"""d_{name} AS (SELECT doc_id, {sql_tokens("text")} AS w FROM documents), a_{name} AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d_{name}),
 q_{name} AS (SELECT item_id, unnest(list_distinct({sql_tokens("text")})) AS term FROM benchmark), t_{name} AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d_{name}) WHERE term IN (SELECT term FROM q_{name}) GROUP BY doc_id, term),
 f_{name} AS (SELECT term, count(*) AS df FROM t_{name} GROUP BY term),
 s_{name} AS (SELECT item_id, doc_id, round(sum({weight} * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * l / al))), 6) AS score FROM t_{name} JOIN f_{name} USING (term) JOIN q_{name} USING (term), a_{name} GROUP BY item_id, doc_id),
 {name} AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s_{name}) WHERE rank <= {k})"""


@query("WITH " + _sql_bm25(K) + " SELECT * FROM ranked")
def search_bm25(spark, sf):
    return _ranked(spark, sf).select("item_id", "doc_id", "score", "rank")


@query("WITH " + _sql_bm25(K, 1.2, positive=False) + " SELECT * FROM ranked")
def search_bm25_plain_idf(spark, sf):
    return _ranked(spark, sf, k1=1.2, positive=False).select("item_id", "doc_id", "score", "rank")


@query("""SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) DESC, v.vec_id)::INT AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def nearest_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return vectors.nearest(rows, asked, "vec_id", "query_id", 10).select("query_id", "vec_id", "score", "rank")


_FUSED = "WITH " + _sql_bm25(K, name="one") + ", " + _sql_bm25(K, 1.2, 0.3, "two") + ", "


@query(_FUSED + """u AS (SELECT item_id, doc_id, 'a' AS arm, rank, 1.0 / (60 + rank) AS share FROM one UNION ALL SELECT item_id, doc_id, 'b', rank, 0.5 / (60 + rank) FROM two)
 SELECT item_id, doc_id, round(sum(share), 6) AS score, max(CASE WHEN arm = 'a' THEN rank END) AS a_rank, max(CASE WHEN arm = 'b' THEN rank END) AS b_rank FROM u GROUP BY item_id, doc_id""")
def fused_ranks(spark, sf):
    tokens = _tokens(spark, sf)
    out = ranking.fuse({"a": _ranked(spark, sf, tokens=tokens), "b": _ranked(spark, sf, tokens=tokens, k1=1.2, b=0.3)}, "item_id", "doc_id", weights={"b": 0.5})
    return out.withColumn("score", F.round("score", 6)).select("item_id", "doc_id", "score", "a_rank", "b_rank")


def _relevant(spark, sf, tokens=None):
    """Documents that hold a passage word for word."""
    words = _tokens(spark, sf) if tokens is None else tokens
    asked = table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text")).alias("words"))
    return evaluation.contamination(words, asked, "doc_id", "item_id", _as_they_are, "words", verbatim=1.0, overlap=2.0).select("item_id", "doc_id")


_WORDS = f"dw AS (SELECT doc_id, ' ' || array_to_string({sql_tokens('text')}, ' ') || ' ' AS p FROM documents), qw AS (SELECT item_id, ' ' || array_to_string({sql_tokens('text')}, ' ') || ' ' AS p, len({sql_tokens('text')}) AS n FROM benchmark), relevant AS (SELECT item_id, doc_id FROM dw JOIN qw ON contains(dw.p, qw.p) WHERE n >= 2)"


@query("WITH " + _WORDS + " SELECT item_id, doc_id FROM relevant")
def verbatim_contamination(spark, sf):
    return _relevant(spark, sf)


_CONTAMINATION = f"""WITH d AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents), q AS (SELECT item_id, {sql_tokens('text')} AS s FROM benchmark), n AS (SELECT count(*) AS n FROM documents), t AS (SELECT doc_id, unnest(list_distinct(w)) AS term FROM d),
 f AS (SELECT term, count(*) AS df FROM t GROUP BY term), i AS (SELECT item_id, term, round(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 4) AS idf FROM (SELECT item_id, unnest(list_distinct(s)) AS term FROM q) LEFT JOIN f USING (term), n),
 z AS (SELECT item_id, sum(idf) AS total FROM i GROUP BY item_id), o AS (SELECT item_id, doc_id, sum(idf) / any_value(total) AS share FROM t JOIN i USING (term) JOIN z USING (item_id) GROUP BY item_id, doc_id),
 g AS (SELECT item_id, l, ' ' || array_to_string(s[a:a + l - 1], ' ') || ' ' AS gram, len(s) AS m FROM (SELECT item_id, s, unnest(range(1, len(s))) AS a FROM q), (SELECT unnest(range(2, 1000)) AS l) WHERE l >= 0.85 * len(s) AND a + l - 1 <= len(s)),
 v AS (SELECT item_id, doc_id, max(l / m) AS run FROM g JOIN (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS p FROM d) ON contains(p, gram) GROUP BY item_id, doc_id)"""


@query(_CONTAMINATION + """SELECT item_id, doc_id, CASE WHEN run IS NOT NULL THEN 'verbatim' ELSE 'overlap' END AS kind, round(coalesce(run, share), 6) AS score FROM o LEFT JOIN v USING (item_id, doc_id) WHERE run IS NOT NULL OR share >= 0.9""")
def contamination(spark, sf):
    """Documents that hold nearly all of a passage, in one run or by the weight of its terms, with kind and score."""
    return _contamination(spark, sf)


def _contamination(spark, sf):
    asked = table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text")).alias("words"))
    return evaluation.contamination(_tokens(spark, sf), asked, "doc_id", "item_id", _as_they_are, "words")


@query(_CONTAMINATION + """, c AS (SELECT item_id, doc_id FROM o LEFT JOIN v USING (item_id, doc_id) WHERE run IS NOT NULL OR share >= 0.9)
 SELECT source, count(DISTINCT item_id)::BIGINT AS questions, count(DISTINCT doc_id)::BIGINT AS documents, count(*)::BIGINT AS pairs FROM c JOIN documents USING (doc_id) GROUP BY source""")
def contamination_by_source(spark, sf):
    return evaluation.contamination_by_source(_contamination(spark, sf), table(spark, sf, "documents"), "item_id", "doc_id", "source")


_FINDINGS = _CONTAMINATION.replace("l >= 0.85 * len(s)", "l >= CASE WHEN item_id % 3 = 0 THEN 0.5 ELSE 0.85 END * len(s)") + """, e AS (SELECT item_id, item_id % 3 = 0 AS negative, CASE WHEN item_id % 3 = 1 THEN ['SRC' || (item_id % 20) || '/', 'src7'] ELSE [] END AS expected FROM benchmark),
 c AS (SELECT o.item_id, doc_id, CASE WHEN run IS NOT NULL THEN 'verbatim' ELSE 'overlap' END AS kind, round(coalesce(run, share), 6) AS score FROM o LEFT JOIN v USING (item_id, doc_id) JOIN e USING (item_id) WHERE run IS NOT NULL OR share >= CASE WHEN negative THEN 0.6 ELSE 0.9 END),
 findings AS (SELECT item_id, doc_id, kind, score, negative OR kind = 'verbatim' AND len(expected) > 0 AND len(list_filter(expected, lambda x: contains(source || '/' || doc_id, lower(x)))) = 0 AS fatal FROM c JOIN e USING (item_id) JOIN documents USING (doc_id))
 """


def _findings(spark, sf):
    """A third of the questions may not be answered, a third expects two sources."""
    d = F.col("item_id")
    asked = table(spark, sf, "benchmark").withColumn("negative", d % 3 == 0).withColumn("expected", F.when(d % 3 == 1, F.array(F.concat(F.lit("SRC"), (d % 20).cast("string"), F.lit("/")), F.lit("src7"))))
    questions = asked.withColumn("words", T.tokens(F.col("text")))
    found = evaluation.contamination(_tokens(spark, sf), questions, "doc_id", "item_id", _as_they_are, "words", negative="negative")
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("blob"))
    return evaluation.fatal_findings(found, asked, docs, "item_id", "doc_id", "negative", "expected", "blob"), asked


@query(_FINDINGS + "SELECT * FROM findings")
def contamination_findings(spark, sf):
    """The same with questions that may not be answered and expected sources: what has to be held out."""
    return _findings(spark, sf)[0]


@query(_FINDINGS + "SELECT (SELECT count(*) FROM benchmark)::BIGINT AS questions_checked, count(DISTINCT CASE WHEN fatal THEN item_id END)::BIGINT AS contaminated_questions, (count(*) FILTER (NOT fatal))::BIGINT AS informational_findings, count(DISTINCT CASE WHEN fatal THEN item_id END) = 0 AS clean FROM findings")
def contamination_summary(spark, sf):
    return evaluation.contamination_report(*_findings(spark, sf), "item_id")


_METRICS = "WITH " + _sql_bm25(K) + ", " + _WORDS + """, z AS (SELECT item_id, count(*) AS nrel FROM relevant GROUP BY item_id),
 h AS (SELECT r.item_id, r.rank, (v.doc_id IS NOT NULL) AS hit FROM ranked r LEFT JOIN relevant v USING (item_id, doc_id)),
 p AS (SELECT item_id, count(*) FILTER (hit AND rank <= 8) AS found, count(*) FILTER (rank <= 8) AS shown, min(CASE WHEN hit THEN rank END) AS f, sum(CASE WHEN hit AND rank <= 8 THEN ln(2) / ln(rank + 1) END) AS dcg FROM h GROUP BY item_id),
 cases AS (SELECT item_id, round(coalesce(found / nrel, 0), 6) AS recall, round(coalesce(found / nullif(shown, 0), 0), 6) AS precision, coalesce(found > 0, false) AS hit, round(coalesce(1.0 / f, 0), 6) AS reciprocal_rank,
 round(coalesce(dcg / list_sum(list_transform(range(1, least(nrel, 8) + 1), lambda i: ln(2) / ln(i + 1))), 0), 6) AS ndcg FROM z LEFT JOIN p USING (item_id)) """


def _cases(spark, sf):
    tokens = _tokens(spark, sf)
    return evaluation.metrics(_ranked(spark, sf, tokens=tokens), _relevant(spark, sf, tokens), "item_id", "doc_id", 8)


@query(_METRICS + "SELECT * FROM cases")
def retrieval_metrics(spark, sf):
    return _cases(spark, sf)


@query(_METRICS + "SELECT count(*)::BIGINT AS cases, round(avg(recall), 4) AS mean_recall, round(avg(precision), 4) AS mean_precision, round(avg(hit::INT), 4) AS mean_hit, round(avg(reciprocal_rank), 4) AS mean_reciprocal_rank, round(avg(ndcg), 4) AS mean_ndcg FROM cases")
def retrieval_report(spark, sf):
    return evaluation.aggregate(_cases(spark, sf))


@query("WITH " + _sql_bm25(K) + """ SELECT item_id, round(max(score), 6) AS top, round(avg(score), 6) AS mean, round(coalesce(max(score) - max(CASE WHEN rank = 2 THEN score END), 0), 6) AS margin,
 round(coalesce((max(score) - max(CASE WHEN rank = 2 THEN score END)) / max(score), 0), 6) AS relative_margin, round(max(score) - min(CASE WHEN rank <= 5 THEN score END), 6) AS margin_5 FROM ranked GROUP BY item_id""")
def abstention_signals(spark, sf):
    return evaluation.signals(_ranked(spark, sf), "item_id")


@query("WITH " + _sql_bm25(8) + f""", w AS (SELECT doc_id, list_distinct({sql_tokens("text")}) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM ranked)), l AS (SELECT item_id, doc_id, w FROM ranked JOIN w USING (doc_id)),
 j AS (SELECT a.item_id, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS j FROM l a JOIN l b ON a.item_id = b.item_id AND a.doc_id < b.doc_id)
 SELECT item_id, count(*)::BIGINT AS pairs, round(avg(j), 6) AS mean, round(median(j), 6) AS median FROM j GROUP BY item_id""")
def redundancy(spark, sf):
    return evaluation.redundancy(_ranked(spark, sf, 8), table(spark, sf, "documents"), "item_id", "doc_id", T.tokens)


@query(f"""WITH q AS (SELECT item_id, unnest(list_distinct({sql_tokens("text")})) AS term FROM benchmark), t AS (SELECT doc_id, unnest(list_distinct({sql_tokens("text")})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
 r AS (SELECT term FROM t, n WHERE term IN (SELECT term FROM q) GROUP BY term, n HAVING count(*) <= n * 0.2), k AS (SELECT * FROM q WHERE term IN (SELECT term FROM r)), z AS (SELECT item_id, count(*) AS terms FROM k GROUP BY item_id),
 b AS (SELECT item_id, max(c) AS best FROM (SELECT item_id, doc_id, count(*) AS c FROM t JOIN k USING (term) GROUP BY item_id, doc_id) GROUP BY item_id)
 SELECT item_id, terms::BIGINT AS terms, round(best / terms, 6) AS share FROM z JOIN b USING (item_id)""")
def cooccurrence(spark, sf):
    terms = lexical.question_terms(table(spark, sf, "benchmark"), "item_id", T.tokens(F.col("text")))
    return evaluation.cooccurrence(table(spark, sf, "documents"), terms, "item_id", "doc_id", T.tokens)


@query("WITH " + _sql_bm25(5) + f""", df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_tokens("text")})) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS n FROM documents), z AS (SELECT item_id, count(*) AS z FROM ranked GROUP BY item_id),
 c AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(list_distinct({sql_tokens("text")})) AS term FROM ranked JOIN documents USING (doc_id)) GROUP BY item_id, term),
 k AS (SELECT c.item_id, term, round(round(ln(1 + (n - df + 0.5) / (df + 0.5)), 4) * ln(1.0 + c), 6) AS score FROM c JOIN z USING (item_id) JOIN df USING (term), n WHERE NOT EXISTS (SELECT 1 FROM q_ranked q WHERE q.item_id = c.item_id AND q.term = c.term) AND length(term) >= 3 AND c / z >= 0.4 AND (c / z) / (df / n) >= 1.5)
 SELECT item_id, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, term DESC)::INT AS rank FROM k) WHERE rank <= 8""")
def expansion_terms(spark, sf):
    words, docs = _tokens(spark, sf), table(spark, sf, "documents")
    feedback = words.join(small_side(_ranked(spark, sf, 5, words).select("item_id", "doc_id")), "doc_id")
    terms = lexical.question_terms(table(spark, sf, "benchmark"), "item_id", T.tokens(F.col("text")))
    return ranking.expansion_terms(feedback, terms, statistics.document_frequency(words, F.col("words")), docs.count(), "item_id", "doc_id")


def candidates(spark, sf, k=K, tokens=None, ranked=None):
    """The k best of each question with what reranking reads. Authority, age and place in a document vary with the id.
    ranked: a list of k or more that was made before."""
    words = _tokens(spark, sf) if tokens is None else tokens
    facts = ranking.question_facts(words, table(spark, sf, "benchmark"), "item_id")
    short = (_ranked(spark, sf, k, words) if ranked is None else ranked.where(F.col("rank") <= k)).withColumn("fused", 1.0 / (60 + F.col("rank")))
    found = words.select("doc_id", "words").join(small_side(short), "doc_id").join(small_side(facts), "item_id")
    d = F.col("doc_id")
    age = F.when(d % 7 != 0, (d % 730).cast("double"))
    return found.select("item_id", "doc_id", "rank", "fused", "asked", "idfs", "sequence", "answerability", "surface", "words", ((d % 11) / 5.0).alias("authority"), age.alias("age_days"), (d % 5).alias("ordinal"))


_PARTS = f"list_filter(regexp_split_to_array(term, '[.\\-/]'), lambda x: length(x) > 1 AND NOT list_contains({[*T.STOPWORDS]}, x))"
#: Each question's words and their weights, compounds that no document has in parts; and what the corpus knows of it.
_FACTS = f""", df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM d_ranked) GROUP BY term), n AS (SELECT count(*) AS n FROM documents), big AS (SELECT count(*) >= 2000 AS big FROM df),
 surf AS (SELECT term FROM df UNION SELECT unnest({_PARTS}) AS term FROM df WHERE regexp_matches(term, '[.\\-/]')),
 raw AS (SELECT DISTINCT item_id, unnest(CASE WHEN d IS NOT NULL OR NOT regexp_matches(term, '[.\\-/]') OR len({_PARTS}) = 0 THEN [term] ELSE {_PARTS} END) AS term FROM (SELECT q.item_id, q.term, df.df AS d FROM q_ranked q LEFT JOIN df USING (term))),
 i AS (SELECT item_id, term, df IS NOT NULL AS has, round(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 4) AS idf FROM raw LEFT JOIN df USING (term), n),
 tot AS (SELECT item_id, sum(idf) AS t1, sum(idf * idf) AS t2, CASE WHEN any_value(big) THEN sum(CASE WHEN has THEN idf ELSE 0 END) / sum(idf) ELSE 1 END AS answerability FROM i, big GROUP BY item_id),
 sp AS (SELECT item_id, term, round(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 4) AS idf, term IN (SELECT term FROM surf) AS known FROM (SELECT item_id, unnest({sql_tokens("text")}) AS term FROM benchmark) LEFT JOIN df USING (term), n),
 su AS (SELECT item_id, CASE WHEN any_value(big) THEN sum(CASE WHEN known THEN idf ELSE 0 END) / sum(idf) ELSE 1 END AS surface FROM sp, big GROUP BY item_id),
 dt AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM d_ranked WHERE doc_id IN (SELECT doc_id FROM ranked)),
 hit AS (SELECT r.item_id, r.doc_id, sum(idf) AS h1, sum(idf * idf) AS h2, max(idf) AS h3 FROM ranked r JOIN i USING (item_id) JOIN dt t ON t.doc_id = r.doc_id AND t.term = i.term GROUP BY r.item_id, r.doc_id),
 qs AS (SELECT item_id, {sql_tokens("text")} AS s FROM benchmark), g AS (SELECT item_id, a, l, ' ' || array_to_string(s[a:a + l - 1], ' ') || ' ' AS gram, len(s) AS m FROM (SELECT item_id, s, unnest(range(1, len(s))) AS a FROM qs), (SELECT unnest(range(2, 200)) AS l) WHERE a + l - 1 <= len(s)),
 pd AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS p FROM d_ranked WHERE doc_id IN (SELECT doc_id FROM ranked)),
 run AS (SELECT r.item_id, r.doc_id, max(l) AS l FROM ranked r JOIN g USING (item_id) JOIN pd USING (doc_id) WHERE contains(p, gram) GROUP BY r.item_id, r.doc_id),
 fe AS (SELECT r.item_id, r.doc_id, r.rank, h2 / t2 AS coverage, h1 / t1 AS gate, h3, coalesce(run.l, 0) / len(s) AS phrase, (0.6 * h1 / t1 + 0.4 * coalesce(run.l, 0) / len(s)) * answerability * surface AS relevance, answerability, surface,
  least(1.5, (r.doc_id % 11) / 5.0) / 1.5 AS authority, CASE WHEN r.doc_id % 7 = 0 THEN 0.5 ELSE exp(-(r.doc_id % 730) / 365.0) END AS recency, 1 / (1 + 0.15 * (r.doc_id % 5)) AS position
  FROM ranked r JOIN hit USING (item_id, doc_id) JOIN tot USING (item_id) JOIN su USING (item_id) JOIN qs USING (item_id) LEFT JOIN run ON run.item_id = r.item_id AND run.doc_id = r.doc_id),
 sc AS (SELECT *, 1.0 / (60 + rank) + 0.45 * coverage + 0.25 * phrase + 0.12 * authority + 0.15 * position AS score FROM fe)"""


@query("WITH " + _sql_bm25(K) + _FACTS + """ SELECT item_id, doc_id, round(coverage, 6) AS coverage, round(gate, 6) AS gate_coverage, round(phrase, 6) AS phrase, round(authority, 6) AS authority, round(recency, 6) AS recency, round(position, 6) AS position, round(relevance, 6) AS relevance, round(score, 6) AS score FROM sc""")
def reranked(spark, sf):
    r = ranking.rerank(candidates(spark, sf))
    return r.select("item_id", "doc_id", *[F.round(c, 6).alias(c) for c in ("coverage", "gate_coverage", "phrase", "authority", "recency", "position", "relevance", "score")])


@query("WITH " + _sql_bm25(K) + _FACTS + """ SELECT item_id, round(t.answerability, 6) AS answerability, round(surface, 6) AS surface, n_words::BIGINT AS n_words FROM tot t JOIN su USING (item_id) JOIN (SELECT item_id, count(*) AS n_words FROM i GROUP BY item_id) USING (item_id)""")
def question_knowledge(spark, sf):
    f = ranking.question_facts(_tokens(spark, sf), table(spark, sf, "benchmark"), "item_id")
    return f.where(F.size("asked") > 0).select("item_id", F.round("answerability", 6).alias("answerability"), F.round("surface", 6).alias("surface"), F.size("asked").cast("long").alias("n_words"))


@query("WITH " + _sql_bm25(K) + _FACTS + """ SELECT item_id, round(max(relevance), 6) AS top, round(max(relevance) - coalesce(max(CASE WHEN place = 2 THEN relevance END), 0), 6) AS gap, round(max(score) - min(score), 6) AS spread, round(max(h3), 6) AS best_idf, round(max(gate), 6) AS document_coverage, round(any_value(answerability), 6) AS answerability, round(any_value(surface), 6) AS surface
 FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, doc_id) AS place FROM sc) GROUP BY item_id""")
def gate_features(spark, sf):
    return retrieval.gate_features(ranking.rerank(candidates(spark, sf)), "item_id")


@query()
def diversified(spark, sf):
    return ranking.mmr(ranking.rerank(candidates(spark, sf)).withColumn("score", F.round("score", 6)), "item_id", "doc_id")


@query()
def hashed_embeddings(spark, sf):
    docs = table(spark, sf, "documents")
    return vectors.embed(docs, statistics.embedder_idf(docs), "doc_id")


@query()
def hybrid_search(spark, sf):
    """Dense and lexical lists fused, for every question."""
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    idf = staged(statistics.embedder_idf(docs), "weights")
    dense = vectors.nearest(staged(vectors.embed(docs, idf, "doc_id"), "vectors"), vectors.embed(asked.select(F.col("item_id"), "text"), idf, "item_id"), "doc_id", "item_id", K)
    return ranking.fuse({"dense": dense, "lexical": _ranked(spark, sf)}, "item_id", "doc_id").withColumn("score", F.round("score", 6))


@query("""SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) DESC, v.vec_id)::INT AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.label % 2 = 0) WHERE rank <= 5""")
def knn_filtered(spark, sf):
    """The nearest among the vectors that a filter allows."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    asked = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return vectors.nearest(rows, asked, "vec_id", "query_id", 5, allowed=rows.where("label % 2 = 0")).select("query_id", "vec_id", "score", "rank")


def _sql_plain(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""WITH f AS (SELECT doc_id, {_sql_plain("text")} AS a, {_sql_plain("source || '/' || doc_id")} AS b, {_sql_plain("'[' || source || '] ' || lang")} AS c FROM documents), l AS (SELECT doc_id, len(a) + len(b) + len(c) AS d FROM f), n AS (SELECT count(*) AS n, avg(d) AS al FROM l),
 q AS (SELECT item_id, term, {_sql_plain("term")} AS p FROM (SELECT item_id, unnest(list_distinct({sql_tokens("text")})) AS term FROM benchmark)), ph AS (SELECT DISTINCT term, p, len(p) AS m FROM q), fw AS (SELECT DISTINCT p[1] AS w FROM ph),
 tk AS (SELECT doc_id, 1.0 AS weight, a AS ws, unnest(range(1, len(a) + 1)) AS i FROM f UNION ALL SELECT doc_id, 0.6, b, unnest(range(1, len(b) + 1)) FROM f UNION ALL SELECT doc_id, 0.4, c, unnest(range(1, len(c) + 1)) FROM f),
 h AS (SELECT doc_id, term, sum(weight) AS f FROM (SELECT * FROM tk WHERE ws[i] IN (SELECT w FROM fw)) tk JOIN ph ON ph.p[1] = ws[i] WHERE ws[i:i + m - 1] = p GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
 s AS (SELECT item_id, doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / al))), 6) AS score FROM h JOIN df USING (term) JOIN q USING (term) JOIN l USING (doc_id), n GROUP BY item_id, doc_id)
 SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= {K}""")
def search_fields(spark, sf):
    """Text, title and header weighed apart, compounds as phrases; unstemmed."""
    docs = _with_fields(table(spark, sf, "documents"))
    return lexical.top(lexical.field_bm25(docs, table(spark, sf, "benchmark"), "doc_id", "item_id", stems=False, k=K), ["item_id"], K, "doc_id").select("item_id", "doc_id", "score", "rank")


def _with_fields(docs):
    return docs.select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("["), "source", F.lit("] "), "lang").alias("context_header"))


def _indexed(spark, docs, analysis, key="doc_id"):
    """A new index of the documents in the shared folder."""
    index = postings.Postings(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", analysis)
    index.put(docs, key)
    return index


@query(ORACLE_SQL["search_fields"])
def search_indexed(spark, sf):
    """The same from a kept inverted index, of which only the windows are read that can hold one of the best."""
    index = _indexed(spark, _with_fields(table(spark, sf, "documents")), postings.Analysis(lexical.FIELDS, phrases=True))
    found = index.search(table(spark, sf, "benchmark"), "item_id", K, k1=1.2, positive=False)
    return found.select("item_id", F.col("key").alias("doc_id"), "score", "rank")


def _without(sql: str) -> str:
    """The query over the documents that are left, some of them with another text."""
    return sql.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' ' || source ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)")


@query(_without("WITH " + _sql_bm25(K) + " SELECT * FROM ranked"))
def purged_postings(spark, sf):
    """An index after documents were removed and others replaced: their postings and statistics are gone exactly."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    index = _indexed(spark, docs, postings.Analysis())
    index.remove(docs.where("doc_id % 7 = 0"), "doc_id")
    index.put(docs.where("doc_id % 7 <> 0 and doc_id % 5 = 0").withColumn("text", F.concat_ws(" ", F.coalesce("text", F.lit("")), "source")), "doc_id")
    return index.search(table(spark, sf, "benchmark"), "item_id", K).select("item_id", F.col("key").alias("doc_id"), "score", "rank")


@query(_without(f"""WITH t AS (SELECT doc_id, unnest(list_distinct({sql_tokens("text")})) AS term FROM documents) SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term"""))
def indexed_frequencies(spark, sf):
    """Document frequencies as the sum of what each segment changed, after removals, replacements and a compaction."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    index = _indexed(spark, docs.where("doc_id % 2 = 0"), postings.Analysis())
    index.put(docs.where("doc_id % 2 = 1"), "doc_id")
    index.remove(docs.where("doc_id % 7 = 0"), "doc_id")
    index.compact()
    index.put(docs.where("doc_id % 7 <> 0 and doc_id % 5 = 0").withColumn("text", F.concat_ws(" ", F.coalesce("text", F.lit("")), "source")), "doc_id")
    return index.frequencies()


@query()
def search_stemmed(spark, sf):
    """The same over Porter stems."""
    docs = _with_fields(table(spark, sf, "documents"))
    return lexical.top(lexical.field_bm25(docs, table(spark, sf, "benchmark"), "doc_id", "item_id", k=K), ["item_id"], K, "doc_id").select("item_id", "doc_id", "score", "rank")


def _corpus(spark, sf, filters=None, expansion=False):
    """Chunks of the documents, the arms' lists for every question, and what is known of the questions."""
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    idf = staged(statistics.embedder_idf(docs), "weights")
    raw = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("source_system"), F.concat(F.lit("doc://"), "source").alias("uri"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("title"), "text", F.lit("prose").alias("kind"), F.lit("").alias("language"))
    chunks = staged(chunked(raw), "chunks")
    # tokens are made once for all that reads them
    words = staged(chunks.select("chunk_id", T.tokens(F.col("indexed_text")).alias("words"), retrieval.may_be_found(filters).alias("allowed")), "words")
    embedded = staged(vectors.embed(words, idf, "chunk_id", words="words", flag="allowed"), "vectors")
    lists = retrieval.arms(chunks, embedded, asked, vectors.embed(asked, idf, "item_id"), "item_id", K, filters, expansion=expansion, words=words, spent=True)
    facts = staged(ranking.question_facts(words.select("words"), asked, "item_id"), "facts")
    return chunks, lists, facts


@query()
def retrieved(spark, sf):
    """The retriever over chunks of some sources: filters, both arms and expansion, fusion, features, a varied short list."""
    chunks, lists, facts = _corpus(spark, sf, {"exclude_source": ["src3"]}, expansion=True)
    out = retrieval.ranked(lists, chunks, facts, "item_id")
    return out.select("item_id", "rank", "chunk_id", F.col("doc_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


@query()
def arm_ablation(spark, sf):
    """Metrics with each part of the retriever switched off in turn; both arms are searched once for all."""
    chunks, lists, facts = _corpus(spark, sf)
    runs = retrieval.ablated(lists, chunks, facts, "item_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    relevant = staged(_relevant(spark, sf), "relevant")
    every = relevant.crossJoin(F.broadcast(runs.sparkSession.createDataFrame([(n,) for n in retrieval.ABLATION], "setting string")))
    both = lambda df: df.withColumn("case", F.struct("setting", "item_id"))
    cases = evaluation.metrics(both(runs), both(every), "case", "doc_id", 8)
    return cases.groupBy(F.col("case.setting").alias("setting")).agg(F.count("*").alias("cases"), *[F.round(F.avg(F.col(c).cast("double")), 4).alias(f"mean_{c}") for c in ("recall", "precision", "hit", "reciprocal_rank", "ndcg")])


@query("WITH " + _sql_bm25(K) + ", " + _WORDS + """, ks AS (SELECT unnest([1, 5, 20, 60, 200]) AS k), f AS (SELECT k, item_id, doc_id, round(1.0 / (k + rank), 9) AS score FROM ranked, ks), z AS (SELECT count(DISTINCT item_id) AS n FROM relevant)
 SELECT k, count(DISTINCT CASE WHEN v.doc_id IS NOT NULL AND score >= round(1.0 / (k + 8), 9) THEN f.item_id END)::BIGINT AS hits, any_value(n)::BIGINT AS cases FROM f LEFT JOIN relevant v USING (item_id, doc_id), z GROUP BY k""")
def fusion_sweep(spark, sf):
    """Questions with a relevant document among the eight best, for several constants of the fusion, in one plan."""
    ks = F.explode(F.array(*[F.lit(k) for k in (1, 5, 20, 60, 200)])).alias("k")
    tokens = _tokens(spark, sf)
    relevant = _relevant(spark, sf, tokens).withColumn("hit", F.lit(1))
    rows = _ranked(spark, sf, tokens=tokens).select("item_id", "doc_id", "rank", ks).withColumn("score", F.round(1.0 / (F.col("k") + F.col("rank")), 9))
    found = rows.join(relevant, ["item_id", "doc_id"], "left").withColumn("in", F.col("hit").isNotNull() & (F.col("score") >= F.round(1.0 / (F.col("k") + 8), 9)))
    n = relevant.agg(F.countDistinct("item_id").alias("cases"))
    return found.groupBy("k").agg(F.countDistinct(F.when(F.col("in"), F.col("item_id"))).alias("hits")).crossJoin(F.broadcast(n))


@query("""WITH e AS (SELECT DISTINCT text AS expectation FROM benchmark), n AS (SELECT count(*) AS total FROM documents)
 SELECT expectation, count(d.doc_id)::BIGINT AS matched, any_value(total)::BIGINT AS total, CASE WHEN count(d.doc_id) = 0 THEN 'nothing' WHEN count(d.doc_id) > 0.2 * any_value(total) THEN 'broad' ELSE 'fine' END AS kind FROM e CROSS JOIN n LEFT JOIN documents d ON contains(lower(d.text), lower(expectation)) GROUP BY expectation""")
def discrimination(spark, sf):
    """How many documents hold each passage as a whole."""
    expected = table(spark, sf, "benchmark").select(F.col("text").alias("expectation"))
    return evaluation.discrimination(table(spark, sf, "documents"), expected, "text", "expectation").select("expectation", "matched", "total", "kind")


def _answered(spark, sf, tokens=None, ranked=None):
    from ..operators import answers as A

    texts = table(spark, sf, "documents").select("doc_id", "text")
    found = staged(ranking.rerank(candidates(spark, sf, 8, tokens, ranked)).withColumn("relevance", F.round("relevance", 6)).drop("words"), "candidates")
    found = texts.join(small_side(found), "doc_id")
    best = found.groupBy("item_id").agg(F.max("score").alias("top"), F.max("relevance").alias("relevance"), F.min("score").alias("least"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.col("rank").cast("int"))).alias("markers"))
    said = A.extractive(A.citations(found.select("item_id", "rank", "text", "score", "asked", "idfs"), "item_id"), "item_id")
    checked = said.join(best, "item_id").withColumn("check", A.verify(F.col("answer"), F.col("markers")))
    no = A.abstains(F.col("top"), F.col("relevance"))
    return checked.select("item_id", no.alias("abstained"), F.when(~no, F.col("check.text")).alias("answer"), "check.coverage", A.confidence(F.col("top"), F.col("least"), F.col("n"), F.col("check.coverage")).alias("confidence"))


def _sql_sentences(t: str) -> str:
    split = f"""string_split(regexp_replace(regexp_replace(coalesce({t}, ''), '([.!?])\\s+([A-Z0-9"''(\\[])', '\\1' || chr(30) || '\\2', 'g'), '\n{{2,}}', chr(30), 'g'), chr(30))"""
    return f"list_filter(list_transform({split}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def _sql_cited(t: str, marker: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '[.!?]$') THEN rtrim(regexp_replace({t}, '[.!?]$', '')) || ' [' || {marker} || ']' || right({t}, 1) ELSE {t} || ' [' || {marker} || ']' END"


#: Sentences that share a word with the question, the best that differ, cited; and the share of claims with a marker. The
#: documents have neither fences nor markers of their own.
_ANSWERED = "WITH " + _sql_bm25(8) + _FACTS + f""", best AS (SELECT item_id, max(score) AS top, max(round(relevance, 6)) AS relevance, min(score) AS least, count(*) AS n FROM sc GROUP BY item_id),
 lists AS (SELECT item_id, rank, greatest(score, 0.0001) AS weight, {_sql_sentences("text")} AS l FROM sc JOIN documents USING (doc_id)), sen AS (SELECT item_id, rank, weight, unnest(l) AS s, unnest(range(len(l))) AS pos FROM lists),
 fit AS (SELECT *, {sql_tokens("s")} AS w FROM sen WHERE len(string_split_regex(s, '\\s+')) BETWEEN 4 AND 60),
 shared AS (SELECT f.item_id, rank, pos, any_value(s) AS s, any_value(w) AS w, any_value(weight) AS weight, sum(idf) AS h, count(*) AS c FROM fit f JOIN i ON i.item_id = f.item_id AND list_contains(w, i.term) GROUP BY f.item_id, rank, pos),
 worth AS (SELECT item_id, rank, pos, s, array_to_string(list_sort(w), ' ') AS key, round((0.7 * h / CASE WHEN t1 > 0 THEN t1 ELSE 1 END + 0.3 * c / len(list_distinct(w)) + 0.05 * weight) * (1 - 0.7 * (CASE WHEN regexp_matches(s, '{T.CODE_START}') THEN 0.6 ELSE 0 END + least(0.4, 2 * (length(s) - length(translate(s, '{T.SYMBOLS}', ''))) / length(s)))::DOUBLE), 9) AS v FROM shared JOIN tot USING (item_id)),
 differ AS (SELECT * FROM worth QUALIFY row_number() OVER (PARTITION BY item_id, key ORDER BY v DESC, rank, pos, s) = 1), picked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY v DESC, rank, pos) AS r FROM differ QUALIFY r <= 5),
 said AS (SELECT item_id, string_agg({_sql_cited("s", "rank")}, ' ' ORDER BY r) AS t FROM picked GROUP BY item_id), opening AS (SELECT item_id, {_sql_cited("array_to_string(l[1:2], ' ')", "1")} AS t FROM lists WHERE rank = 1),
 full_text AS (SELECT item_id, regexp_replace(regexp_replace(coalesce(said.t, opening.t), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM opening LEFT JOIN said USING (item_id)),
 claimed AS (SELECT item_id, t, list_filter({_sql_sentences("t")}, lambda x: len(string_split_regex(x, '\\s+')) >= 5 AND NOT regexp_matches(x, '^\\s*(?:[-*#>]|\\d+[.)])')) AS l FROM full_text),
 covered AS (SELECT item_id, t, CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '(?:^|[^A-Za-z0-9_)\\]])\\[\\d+\\]'))) / len(l), 4) ELSE (t <> '')::INT::DOUBLE END AS coverage FROM claimed),
 said_all AS (SELECT item_id, top < 0.005 OR relevance < 0.19 AS abstained, t, coverage, round(0.5 * least(1, top / 0.6) + 0.2 * CASE WHEN n > 1 THEN least(1, (top - least) / 0.25) ELSE 0.5 END + 0.3 * coverage, 4) AS confidence FROM covered JOIN best USING (item_id)),
 answers AS (SELECT item_id, abstained, CASE WHEN NOT abstained THEN t END AS answer, coverage, confidence FROM said_all)"""


@query(_ANSWERED + ", " + _sql_bm25(K, name="deep") + ", " + _METRICS.partition(_WORDS)[2].join([_WORDS, ""]).replace("FROM ranked", "FROM deep") + """,
 e AS (SELECT a.*, c.recall IS NULL AS negative, CASE WHEN c.recall IS NULL THEN abstained ELSE NOT abstained AND hit END AS passed, recall, precision, hit, reciprocal_rank, ndcg FROM answers a LEFT JOIN cases c USING (item_id))
 SELECT count(*)::BIGINT AS cases, round(avg(passed::INT), 4) AS pass_rate, round(avg(abstained::INT), 4) AS abstention_rate, (count(*) FILTER (negative AND NOT abstained))::BIGINT AS answered_negatives, (count(*) FILTER (NOT negative AND abstained))::BIGINT AS refused_positives,
 round(avg(coverage) FILTER (NOT negative AND NOT abstained), 4) AS citation_coverage, round(avg(recall) FILTER (NOT negative), 4) AS mean_recall, round(avg(precision) FILTER (NOT negative), 4) AS mean_precision, round(avg(hit::INT) FILTER (NOT negative), 4) AS mean_hit, round(avg(reciprocal_rank) FILTER (NOT negative), 4) AS mean_reciprocal_rank, round(avg(ndcg) FILTER (NOT negative), 4) AS mean_ndcg FROM e""")
def evaluation_report(spark, sf):
    """One row for the whole run: pass rate, abstentions, citations and metrics. A question without a document that holds
    it is one to abstain from; another passes if it is answered and such a document is shown."""
    tokens = _tokens(spark, sf)
    relevant = staged(_relevant(spark, sf, tokens), "relevant")
    # one search for both: the answers' eight are the first of these
    ranked = staged(_ranked(spark, sf, tokens=tokens), "ranked")
    metrics = evaluation.metrics(ranked, relevant, "item_id", "doc_id", 8)
    cases = _answered(spark, sf, tokens, ranked).join(metrics, "item_id", "left").withColumn("expect_abstain", F.col("recall").isNull())
    return evaluation.report(cases.withColumn("passed", F.when(F.col("expect_abstain"), F.col("abstained")).otherwise(~F.col("abstained") & F.col("hit"))))


@query(_ANSWERED + " SELECT * FROM answers")
def answers(spark, sf):
    """A cited answer to each question from its eight best documents, or the reason for none."""
    return _answered(spark, sf)
