"""Queries on term statistics, text functions, snapshots and sources, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import redaction, text as T, urls
from ..operators import evaluation, incremental, statistics
from .tables import sql_all, sql_tokens, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""SELECT doc_id, len({sql_tokens("text")})::BIGINT AS n_tokens, len({sql_all("text")})::BIGINT AS n_all,
 CASE WHEN length(text) = 0 THEN 0 ELSE greatest(length(text) - length(translate(text, ' ' || chr(10), '')) + 1, length(text) // 4) END::BIGINT AS estimated
 FROM documents""")  # fmt: skip
def token_counts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.size(T.tokens(t)).cast("long").alias("n_tokens"), F.size(T.all_tokens(t)).cast("long").alias("n_all"), T.estimate_tokens(t).alias("estimated"))


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_tokens("text")})) AS term FROM documents) GROUP BY term)
 SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 4) AS idf FROM d, n""")
def term_idf(spark, sf):
    return statistics.idf_table(table(spark, sf, "documents"), T.tokens(F.col("text")))


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_tokens("text")})) AS term FROM documents) GROUP BY term)
 SELECT term, df::BIGINT AS df, round(greatest(0.05, ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS idf FROM d, n""")
def embedder_weights(spark, sf):
    return statistics.embedder_idf(table(spark, sf, "documents")).withColumn("idf", F.round("idf", 6))


@query()
def stem_frequency(spark, sf):
    return statistics.stemmed_frequency(table(spark, sf, "documents"))


@query(f"""WITH t AS (SELECT DISTINCT unnest({sql_tokens("text")}) AS term FROM documents), p AS (SELECT unnest(regexp_split_to_array(term, '[.\\-/]')) AS term FROM t WHERE regexp_matches(term, '[.\\-/]'))
 SELECT term FROM t UNION SELECT term FROM p WHERE length(term) > 1 AND NOT list_contains({[*T.STOPWORDS]}, term)""")
def surface_vocabulary(spark, sf):
    return statistics.surface_vocabulary(table(spark, sf, "documents"))


@query(f"""WITH t AS (SELECT DISTINCT unnest({sql_tokens("text")}) AS term FROM documents), g AS (SELECT CASE WHEN length(term) <= 4 THEN ['^' || term || '$'] ELSE list_transform(range(1, length(term) + 0), lambda i: substr('^' || term || '$', i, 4)) END AS g FROM t)
 SELECT gram, count(*)::BIGINT AS terms FROM (SELECT unnest(list_distinct(g)) AS gram FROM g) GROUP BY gram""")
def gram_frequency(spark, sf):
    terms = statistics.document_frequency(table(spark, sf, "documents"), T.tokens(F.col("text"))).select("term")
    return terms.select(F.explode(F.array_distinct(T.char_ngrams(F.col("term")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("terms"))


@query("""SELECT source, count(*)::BIGINT AS documents, count(e.vec_id)::BIGINT AS embedded, round(count(e.vec_id) / count(*), 4) AS coverage
 FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON e.vec_id = d.doc_id GROUP BY source""")
def corpus_stats(spark, sf):
    return statistics.corpus_stats(table(spark, sf, "documents"), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "source")


@query("""WITH s AS (SELECT lang, length(text) AS v, row_number() OVER (PARTITION BY lang ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
 SELECT lang, n::BIGINT AS n, round(sum(v) / n, 1) AS mean, min(v)::INT AS min, max(CASE WHEN i = floor(n * 0.5) THEN v END)::INT AS p50, max(CASE WHEN i = floor(n * 0.95) THEN v END)::INT AS p95, max(v)::INT AS max FROM s GROUP BY lang, n""")
def length_summary(spark, sf):
    return statistics.indexed_summary(table(spark, sf, "documents").select("lang", F.length("text").alias("v")), "v", ["lang"])


@query("""SELECT count(*)::BIGINT AS n, sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR AS low, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR AS high
 FROM (SELECT substr(sha256(doc_id || chr(31) || text || chr(31)), 1, 16) AS h FROM documents)""")
def corpus_signature(spark, sf):
    return statistics.signature(table(spark, sf, "documents"), T.content_hash(F.col("doc_id"), F.col("text")))


@query("""SELECT doc_id, substr(sha256(source || chr(31) || doc_id || chr(31)), 1, 24) AS stable_id, substr(sha256(text || chr(31)), 1, 16) AS content_hash FROM documents""")
def document_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.stable_id(F.col("source"), F.col("doc_id")).alias("stable_id"), T.content_hash(F.col("text")).alias("content_hash"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents""")
def markup_stripped(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_markup(F.col("text")).alias("text"))


@query()
def cleaned_redacted(spark, sf):
    return table(spark, sf, "documents").select("doc_id", redaction.redact(T.clean(F.col("text"))).alias("text"))


@query("SELECT kind, sum(len(regexp_extract_all(text, pattern)))::BIGINT AS found FROM documents, (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p, _ in redaction.SECRETS if n in redaction.PLAIN) + ") AS p(kind, pattern) GROUP BY kind")
def secrets_found(spark, sf):
    each = F.array(*[F.struct(F.lit(n).alias("kind"), F.regexp_count("text", F.lit(p)).alias("c")) for n, p, _ in redaction.SECRETS if n in redaction.PLAIN])
    return table(spark, sf, "documents").select(F.explode(each).alias("x")).groupBy("x.kind").agg(F.sum("x.c").cast("long").alias("found"))


@query(f"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])\\s+([A-Z0-9"''(\\[])', '\\1' || chr(30) || '\\2', 'g'), '\n{{2,}}', chr(30), 'g'), chr(30))) AS raw FROM documents), t AS (SELECT doc_id, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM s),
 c AS (SELECT doc_id, CASE WHEN regexp_matches(s, '{T.CODE_START}') THEN 0.6 ELSE 0 END + least(0.4, 2 * (length(s) - length(translate(s, '{T.SYMBOLS}', ''))) / length(s)) AS code FROM t WHERE s <> '')
 SELECT d.doc_id, count(code)::INT AS sentences, round(coalesce(sum(code::DOUBLE), 0), 6) AS code FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id""")
def sentence_counts(spark, sf):
    s = T.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("sentences"), F.round(F.aggregate(F.transform(s, T.code_likeness), F.lit(0.0), lambda a, x: a + x), 6).alias("code"))


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS p FROM pages),
 q AS (SELECT page_id, p, list_sort(list_transform(list_filter(string_split(p.query, '&'), lambda x: x <> '' AND NOT list_contains(""" + str([*urls.TRACKING]) + """, lower(split_part(x, '=', 1)))), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS pairs FROM u)
 SELECT page_id, p.scheme || '://' || lower(p.host) || CASE WHEN p.path = '' THEN '/' ELSE regexp_replace(p.path, '/index\\.html$', '/') END || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS url, lower(p.host) AS host FROM q""")  # fmt: skip
def normalized_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"), urls.host(F.col("url")).alias("host"))


@query("""SELECT CASE WHEN contains(html, '<title>Client Challenge</title>') OR contains(html, '/_fs-ch-') THEN 'Fastly client challenge' WHEN contains(html, '<title>Just a moment...</title>') OR contains(html, 'cf-browser-verification') THEN 'Cloudflare interstitial' WHEN contains(html, '<title>Attention Required!') THEN 'Cloudflare block page' ELSE '' END AS reason, count(*)::BIGINT AS pages FROM pages GROUP BY 1""")
def interstitials(spark, sf):
    return table(spark, sf, "pages").groupBy(urls.interstitial_reason(F.col("html")).alias("reason")).agg(F.count("*").alias("pages"))


@query("""SELECT verdict, count(*)::BIGINT AS pages FROM (SELECT CASE WHEN page_id % 5 > 2 THEN 'depth' WHEN regexp_matches(url, '(?i)\\.(png|jpg|gif|pdf|zip)$') THEN 'binary_ext' WHEN NOT (h = 'example.com' OR h LIKE '%.example.com') THEN 'offsite' WHEN url LIKE '%/fr/%' THEN 'excluded' ELSE 'ok' END AS verdict FROM (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h FROM pages)) GROUP BY verdict""")
def crawl_verdicts(spark, sf):
    verdict = urls.crawl_verdict(F.col("url"), F.col("page_id") % 5, F.lit("https://example.com/"), exclude="/fr/")
    return table(spark, sf, "pages").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("pages"))


@query("""SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src2', 'src3') AND source NOT IN ('src2') AND starts_with(lower('doc://' || source || '/' || doc_id), 'doc://src') AND n_chars >= 500 AND lang IS NOT NULL""")
def filtered_documents(spark, sf):
    from ..operators.filters import matching

    docs = table(spark, sf, "documents").withColumn("uri", F.concat_ws("/", F.lit("doc:/"), "source", F.col("doc_id").cast("string")))
    return docs.where(matching({"source": ["src1", "src2", "src3"], "exclude_source": ["src2"], "uri_prefix": "DOC://src", "at_least": ("n_chars", 500)}, source="source", uri="uri")).where("lang is not null").select("doc_id", "source", "lang")


@query("""SELECT d.doc_id AS chunk_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.label % 2 = 0)""")
def missing_embeddings(spark, sf):
    """Rows without a vector, or with one of another space only."""
    from ..operators.index import missing_vectors

    made = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("space:"), F.col("label") % 2).alias("fingerprint"))
    return missing_vectors(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), made, "space:0")


_SNAPSHOTS = """WITH a AS (SELECT source, doc_id, substr(sha256(CASE WHEN lang = 'de' THEN lower(text) ELSE text END || chr(31)), 1, 16) AS h FROM documents WHERE source <> 'src3'),
 b AS (SELECT source, doc_id, substr(sha256(text || chr(31)), 1, 16) AS h FROM documents WHERE source <> 'src7'),
 c AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.source = b.source AND a.doc_id = b.doc_id) """


def _snapshots(spark, sf):
    docs = table(spark, sf, "documents")
    older = docs.where("source <> 'src3'").withColumn("text", F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text")))
    cut = lambda d: d.select("source", "doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return cut(older), cut(docs.where("source <> 'src7'"))


@query(_SNAPSHOTS + "SELECT source, doc_id, status FROM c")
def snapshot_delta(spark, sf):
    return incremental.delta(*_snapshots(spark, sf), ["source", "doc_id"])


@query(_SNAPSHOTS + "SELECT source, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed, 0::BIGINT AS failed FROM c GROUP BY source")
def snapshot_counts(spark, sf):
    return incremental.delta_counts(incremental.delta(*_snapshots(spark, sf), ["source", "doc_id"]), "source")


@query("""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.source, n.source) AS source, CASE WHEN n.doc_id IS NOT NULL THEN n.text ELSE o.text END AS text, coalesce(o.created_at, n.created_at) AS created_at
 FROM (SELECT doc_id, source, text, 1 AS created_at FROM documents WHERE source <> 'src3') o FULL JOIN (SELECT doc_id, 'moved' AS source, upper(lang) AS text, 2 AS created_at FROM documents WHERE lang <> 'en') n ON o.doc_id = n.doc_id""")
def upserted_documents(spark, sf):
    docs = table(spark, sf, "documents")
    old = docs.where("source <> 'src3'").select("doc_id", "source", "text", F.lit(1).alias("created_at"))
    new = docs.where("lang <> 'en'").select("doc_id", F.lit("moved").alias("source"), F.upper("lang").alias("text"), F.lit(2).alias("created_at"))
    return incremental.upsert(old, new, ["doc_id"], keep=("source", "created_at"))


@query("""SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT doc_id, 9 AS quality, 9 AS toxic FROM documents WHERE lang = 'fr'""")
def replaced_rows(spark, sf):
    new = table(spark, sf, "documents").where("lang = 'fr'").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    labels = table(spark, sf, "labels")
    return incremental.replaced(labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")), new, "doc_id")


@query("""WITH g AS (SELECT d.*, l.toxic = 1 AS gone FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)), s AS (SELECT source, avg(CASE WHEN gone THEN 1.0 ELSE 0.0 END) AS share FROM g GROUP BY source)
 SELECT doc_id, g.source FROM g JOIN s USING (source) WHERE gone IS NOT TRUE OR share > 0.04""")
def guarded_prune(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return incremental.pruned(table(spark, sf, "documents"), gone, "doc_id", "source", 0.04).select("doc_id", "source")


@query("""SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""")
def journal_tail(spark, sf):
    from ..operators.index import newest

    return newest(table(spark, sf, "events"), ["ts", "event_id"], 50).select("event_id", "user_id", "event_type")


_HEALTH = """WITH t AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, count(*) AS runs, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS failure_rate, max(CASE WHEN event_type <> 'error' THEN ts END) AS ok FROM events GROUP BY user_id),
 s AS (SELECT e.user_id, count(*) AS c FROM events e JOIN l ON e.user_id = l.user_id WHERE event_type = 'error' AND (ok IS NULL OR ts > ok) GROUP BY e.user_id),
 h AS (SELECT l.user_id, runs, failure_rate, coalesce(c, 0) AS consecutive_failures, CASE WHEN ok IS NULL THEN 999.0 ELSE round((epoch_us(now) - epoch_us(ok)) / 3.6e9, 2) END AS hours_since_success FROM l CROSS JOIN t LEFT JOIN s ON s.user_id = l.user_id) """


def _health(spark, sf):
    events = table(spark, sf, "events")
    runs = events.select("user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return incremental.source_health(runs, "user_id", "ts", "failed", now)


@query(_HEALTH + "SELECT user_id, runs, failure_rate, consecutive_failures, hours_since_success FROM h")
def source_health(spark, sf):
    return _health(spark, sf)


@query(_HEALTH + """SELECT user_id, 'quarantine_source' AS kind, 80 AS priority FROM h WHERE consecutive_failures >= 3 UNION ALL SELECT user_id, 'alert', 60 FROM h WHERE consecutive_failures < 3 AND failure_rate > 0.25 UNION ALL SELECT user_id, 'backfill_source', 50 FROM h WHERE consecutive_failures < 3 AND hours_since_success > 24""")
def source_actions(spark, sf):
    return incremental.actions(_health(spark, sf), "user_id")


@query("""SELECT conv_id, count(*)::BIGINT AS turns, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id HAVING count(*) >= 2""")
def chat_documents(spark, sf):
    from ..sources.chat import sessions

    return sessions(table(spark, sf, "conversations"), "conv_id")


@query("""SELECT doc_id, source, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def content_dedupe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text").withColumn("h", F.sha2("text", 256))
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(firsts, "doc_id", "left_semi").select("doc_id", "source", "text")


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), l AS (SELECT DISTINCT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
 SELECT l.source, line, count(*)::BIGINT AS documents FROM l JOIN n ON n.source = l.source WHERE line <> '' GROUP BY l.source, line, n HAVING count(*) >= 0.05 * n AND n >= 5""")
def template_lines(spark, sf):
    from ..operators.templates import learned

    return learned(table(spark, sf, "documents"), "source", "doc_id", F.split("text", "\n"), share=0.05)


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def carried_value(spark, sf):
    events = table(spark, sf, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return incremental.carried_forward(events, "user_id", ["ts", "event_id"], "p", "last_purchase").select("event_id", "user_id", "last_purchase")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL""")
def hourly_events(spark, sf):
    from ..streaming.windows import tumbling

    return tumbling(table(spark, sf, "events"), "ts", "1 hour", ["event_type"]).select(F.col("start").alias("hour"), "event_type", "events", "value")


@query("""WITH b AS (SELECT n_chars AS s, sum((quality = 1)::INT)::BIGINT AS p, sum((quality = 0)::INT)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY n_chars), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
 SELECT sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(sum(p * (below + n / 2)) / (sum(p)::DOUBLE * sum(n)), 6) AS auc FROM c""")
def label_auc(spark, sf):
    scored = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("n_chars", (F.col("quality") == 1).alias("good"))
    return evaluation.auc(scored, "n_chars", "good")


@query("""WITH s AS (SELECT round(least(n_chars, 5000) / 5000.0, 2) AS floor, quality = 1 AS good FROM documents JOIN labels USING (doc_id)), f AS (SELECT DISTINCT floor FROM s)
 SELECT f.floor, count(*) FILTER (good AND s.floor < f.floor) AS refused_positives, count(*) FILTER (NOT good AND s.floor >= f.floor) AS answered_negatives, count(*) FILTER (good AND s.floor < f.floor) + count(*) FILTER (NOT good AND s.floor >= f.floor) AS errors FROM f, s GROUP BY f.floor""")
def floor_sweep(spark, sf):
    scored = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select((F.least("n_chars", F.lit(5000)) / 5000.0).alias("s"), (F.col("quality") == 1).alias("good"))
    return evaluation.floors(scored, "s", "good")


def _sql_size(t: str) -> str:
    return f"(CASE WHEN length({t}) = 0 THEN 0 ELSE greatest(length({t}) - length(translate({t}, ' ' || chr(10), '')) + 1, length({t}) // 4) END)"


def _sql_strip(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


#: Documents without headings or fences in chunks: sentences packed unit by unit, then small pieces merged, by recursions.
_CHUNKS = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_sql_strip("text")} AS s FROM documents WHERE text IS NOT NULL), big AS (SELECT * FROM d WHERE {_sql_size("s")} > 640),
 cut AS (SELECT doc_id, unnest(p) AS raw, unnest(range(len(p))) AS unit FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(s, '([.!?])\\s+([A-Z0-9"''(\\[])', '\\1' || chr(30) || '\\2', 'g'), '\n{{2,}}', chr(30), 'g'), chr(30)) AS p FROM big)),
 u AS (SELECT doc_id, unit, {_sql_strip("raw")} AS t FROM cut WHERE {_sql_strip("raw")} <> ''), v AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l, {_sql_size("t")} > 640 AS over FROM u),
 w AS (SELECT doc_id, unit, unnest(CASE WHEN over AND len(l) > 1 THEN l ELSE [t] END) AS t, unnest(range(CASE WHEN over AND len(l) > 1 THEN len(l) ELSE 1 END)) AS line, over AND len(l) > 1 AS apart FROM v),
 z AS (SELECT *, {_sql_size("t")} AS z, CASE WHEN {_sql_size("t")} > 640 THEN unit || '/' || line WHEN apart THEN unit || '' ELSE '' END AS o FROM w),
 nw AS (SELECT *, (lag(o) OVER (PARTITION BY doc_id ORDER BY unit, line) IS DISTINCT FROM o)::INT AS fresh FROM z), rn AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY unit, line) AS run FROM nw),
 r AS (SELECT doc_id, run, t, z, apart, row_number() OVER e - 1 AS k, coalesce(sum(z) OVER (PARTITION BY doc_id, run ORDER BY unit, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM rn WINDOW e AS (PARTITION BY doc_id, run ORDER BY unit, line)),
 c AS (SELECT a.doc_id, a.run, a.k, any_value(a.x) AS x, any_value(a.z) AS z, min(b.k) FILTER (a.x - b.x <= 64) AS back, min(b.x) FILTER (a.x - b.x <= 64) AS backx FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.run = b.run AND b.k BETWEEN a.k - 65 AND a.k GROUP BY a.doc_id, a.run, a.k),
 g AS (SELECT doc_id, run, 0::BIGINT AS k, 0::BIGINT AS f, 0::HUGEINT AS fx, NULL::BIGINT AS ef FROM c WHERE k = 0
  UNION ALL SELECT g.doc_id, g.run, c.k, CASE WHEN c.x - fx + c.z > 320 THEN greatest(f, back) ELSE f END, CASE WHEN c.x - fx + c.z > 320 THEN greatest(fx, backx) ELSE fx END, CASE WHEN c.x - fx + c.z > 320 THEN f END FROM g JOIN c ON c.doc_id = g.doc_id AND c.run = g.run AND c.k = g.k + 1),
 e AS (SELECT doc_id, run, ef AS a, k AS b FROM g WHERE ef IS NOT NULL UNION ALL SELECT doc_id, run, max_by(f, k), max(k) + 1 FROM g GROUP BY doc_id, run),
 pc AS (SELECT e.doc_id, e.run, e.a, e.b, CASE WHEN apart THEN string_agg(t, chr(10) ORDER BY k) ELSE string_agg(t, ' ' ORDER BY k) END AS t FROM e JOIN r ON r.doc_id = e.doc_id AND r.run = e.run AND r.k >= e.a AND r.k < e.b GROUP BY e.doc_id, e.run, e.a, e.b, apart),
 p AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY run, a, b) - 1 AS p, length(t) AS n, length(t) - length(translate(t, ' ' || chr(10), '')) AS br FROM pc),
 m AS (SELECT doc_id, 0::BIGINT AS p, n::BIGINT AS n, br::BIGINT AS br, 0 AS grp FROM p WHERE p = 0
  UNION ALL SELECT m.doc_id, p.p, CASE WHEN j THEN m.n + p.n + 2 ELSE p.n END, CASE WHEN j THEN m.br + p.br + 2 ELSE p.br END, CASE WHEN j THEN grp ELSE grp + 1 END FROM m JOIN p ON p.doc_id = m.doc_id AND p.p = m.p + 1, LATERAL (SELECT greatest(p.br + 1, p.n // 4) < 32 AND greatest(m.br + 1, m.n // 4) + greatest(p.br + 1, p.n // 4) <= 640 AS j)),
 gs AS (SELECT doc_id, grp, max_by(greatest(br + 1, n // 4), p) AS z FROM m GROUP BY doc_id, grp), f AS (SELECT a.doc_id FROM gs a JOIN gs b ON a.doc_id = b.doc_id AND a.grp = 0 AND b.grp = 1 WHERE a.z < 32 AND a.z + b.z <= 640),
 o AS (SELECT doc_id, 0 AS place, s AS t FROM d WHERE {_sql_size("s")} <= 640 AND s <> '' UNION ALL SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY grp) - 1, {_sql_strip("t")} FROM (SELECT doc_id, grp, string_agg(t, chr(10) || chr(10) ORDER BY p) AS t FROM (SELECT m.doc_id, CASE WHEN grp = 1 AND f.doc_id IS NOT NULL THEN 0 ELSE grp END AS grp, m.p, p.t FROM m JOIN p ON p.doc_id = m.doc_id AND p.p = m.p LEFT JOIN f ON f.doc_id = m.doc_id) GROUP BY doc_id, grp))
 """


def _chunked(spark, sf):
    from ..operators.chunking import chunked

    docs = table(spark, sf, "documents")
    return chunked(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("source_system"), F.concat(F.lit("doc://"), "source").alias("uri"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("title"), "text", F.lit("prose").alias("kind"), F.lit("").alias("language")))


@query(_CHUNKS + f"""SELECT o.doc_id::VARCHAR AS doc_id, place::INT AS ordinal, substr(sha256(o.doc_id || chr(31) || place || chr(31) || substr(t, 1, 200) || chr(31)), 1, 24) AS chunk_id, '[' || source || '] ' || source || '/' || o.doc_id AS context_header, t AS text, {_sql_size("t")}::INT AS tokens FROM o JOIN documents USING (doc_id)""")
def chunks(spark, sf):
    return _chunked(spark, sf).select("doc_id", "ordinal", "chunk_id", "context_header", "text", "tokens")


@query(_CHUNKS + f""", s AS (SELECT source, {_sql_size("t")} AS v FROM o JOIN documents USING (doc_id)), q AS (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM s)
 SELECT source, n::BIGINT AS n, round(sum(v) / n, 1) AS mean, min(v)::INT AS min, max(CASE WHEN i = floor(n * 0.5) THEN v END)::INT AS p50, max(CASE WHEN i = floor(n * 0.95) THEN v END)::INT AS p95, max(v)::INT AS max FROM q GROUP BY source, n""")
def chunk_sizes(spark, sf):
    """How long each source's chunks are."""
    return statistics.indexed_summary(_chunked(spark, sf).select(F.col("source_system").alias("source"), F.col("tokens").alias("v")), "v", ["source"])


@query(_CHUNKS + """SELECT o.doc_id::VARCHAR AS doc_id, place::INT AS ordinal, coalesce(d.source || '/' || d.doc_id, '') AS title FROM o LEFT JOIN (SELECT * FROM documents WHERE source <> 'src3') d ON d.doc_id = o.doc_id""")
def chunk_titles(spark, sf):
    """Chunks with their documents' titles; those of unknown documents stay, without one."""
    docs = table(spark, sf, "documents").where("source <> 'src3'").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"))
    return _chunked(spark, sf).join(docs, "doc_id", "left").select("doc_id", "ordinal", F.coalesce("name", F.lit("")).alias("title"))


@query(_CHUNKS + """SELECT o.doc_id::VARCHAR AS doc_id, place::INT AS ordinal FROM o JOIN documents d ON d.doc_id = o.doc_id JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0) l ON l.doc_id = o.doc_id WHERE d.lang = 'en' AND d.source <> 'src5'""")
def filtered_chunks(spark, sf):
    """Chunks whose documents pass filters: their columns by a join, a long list of ids by a semi-join."""
    from ..operators.filters import in_documents, matching

    docs = table(spark, sf, "documents").where(matching({"exclude_source": ["src5"]}, source="source")).where("lang = 'en'").select(F.col("doc_id").cast("string").alias("doc_id"))
    known = table(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    return in_documents(_chunked(spark, sf).join(docs, "doc_id"), known, "doc_id").select("doc_id", "ordinal")


@query(f"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])\\s+([A-Z0-9"''(\\[])', '\\1' || chr(30) || '\\2', 'g'), '\n{{2,}}', chr(30), 'g'), chr(30))) AS raw FROM documents), t AS (SELECT doc_id, {_sql_strip("raw")} AS s FROM s WHERE {_sql_strip("raw")} <> '')
 SELECT d.doc_id, count(s)::BIGINT AS sentences, coalesce(sum({_sql_size("s")}), 0)::BIGINT AS tokens FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id""")
def sentence_sizes(spark, sf):
    s = T.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.aggregate(F.transform(s, T.estimate_tokens), F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))


@query()
def page_markdown(spark, sf):
    from ..sources.pages import extracted

    return extracted(table(spark, sf, "pages")).select("page_id", "title", "lang", "text", "word_count", "link_density", "blocked")


@query("""WITH a AS (SELECT concat_ws('/', lang, source, doc_id) AS path, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT concat_ws('/', lang, source, doc_id) AS path, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE md5(coalesce(text, '')) END AS digest FROM documents WHERE doc_id % 13 <> 0)
 SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest""")
def tree_changes(spark, sf):
    """What differs between two listings, found by their hash trees."""
    from ..operators import trees

    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    new = d.where("doc_id % 13 <> 0").withColumn("digest", F.when(F.col("doc_id") % 17 == 0, F.lit("x")).otherwise(F.col("digest")))
    return trees.changed_files(trees.tree(d.where("doc_id % 11 <> 0")), trees.tree(new))
