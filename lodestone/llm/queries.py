"""Registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, gif_media, hard_negatives, jaccard_join, language_spans, pair_index_bpe, quality_rules, sharding, spelling_variants, suffix_dedup, tag_paths, token_files, weak_quality
from .shared import staged

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weak_quality.classified(docs, weak_quality.fitted(docs)[1])


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_digests(staged(gif_media.with_media(table(spark, sf_dir, "documents")), "media"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.packed(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0, capacity=2048)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_digests(token_files.write_blocks(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fitted(docs, table(spark, sf_dir, "labels")))


def op9_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_index_bpe.round_trip_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extracted(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_spans.fitted(docs.where(~language_spans.is_held_out()).select("text", "lang"))
    found = language_spans.identified(docs, model)
    return found.select("doc_id", language_spans.is_held_out().alias("held_out"), "lang_pred", "score", "n_spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_jaccard_join, op2_sharding, op3_quality_classifier, op4_gif_media, op5_suffix_dedup, op6_best_fit_packing, op7_token_files, op8_quality_rules, op9_pair_index_bpe, op10_html_extraction, op11_hard_negatives, op12_spelling_variants, op13_language_id)
}

#: The shards' turns as a recursion: each claims the first slot it prefers of those still free.
_FILL = f"""WITH RECURSIVE p AS (SELECT list(o ORDER BY s) AS o, list(k ORDER BY s) AS k FROM (SELECT s, ('0x' || substr(md5('offset-' || s), 1, 15))::BIGINT % {sharding.SLOTS} AS o, ('0x' || substr(md5('skip-' || s), 1, 15))::BIGINT % {sharding.SLOTS - 1} + 1 AS k FROM range({sharding.SHARDS}) t(s))),
 fill AS (SELECT 0 AS turn, -1::BIGINT AS slot, list_transform(range({sharding.SLOTS}), lambda x: -1::INT) AS owner
  UNION ALL SELECT turn + 1, slot, list_transform(owner, lambda v, i: CASE WHEN i = slot + 1 THEN (turn % {sharding.SHARDS})::INT ELSE v END) FROM (
   SELECT turn, owner, (o[turn % {sharding.SHARDS} + 1] + (list_position(list_transform(range({sharding.SLOTS}), lambda x: owner[(o[turn % {sharding.SHARDS} + 1] + x * k[turn % {sharding.SHARDS} + 1]) % {sharding.SLOTS} + 1] < 0), true) - 1) * k[turn % {sharding.SHARDS} + 1]) % {sharding.SLOTS} AS slot FROM fill, p WHERE turn < {sharding.SLOTS})),
 shards AS (SELECT slot, ((turn - 1) % {sharding.SHARDS})::INT AS shard FROM fill WHERE turn > 0)
 SELECT doc_id, d.slot, shard FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents) d JOIN shards s ON s.slot = d.slot"""

#: All scores of anchors and rows, the first of each anchor's label, and the first of other labels in their windows.
_MINED = """WITH v AS (SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 scored AS (SELECT a.place AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.place, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.place <> b.place),
 positive AS (SELECT anchor, place AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, place) <= 5)
 SELECT s.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY s.anchor, p.positive ORDER BY s.score DESC, s.vec_id NULLS LAST, s.place))::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
 FROM positive p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
 QUALIFY rank <= 10"""

#: Checksums byte by byte from a table, words that share what is left after leaving one code point out, and forms by recursion.
_VARIANTS = """WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t FROM range(256) r(b)),
 runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
 each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
 summed AS (SELECT run, n, xor(list_reduce(list_transform(range(octet_length(encode(id || ':' || run)) ), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h FROM each, crc),
 spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM summed),
 words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
 holes AS MATERIALIZED (SELECT word, n, word AS rest, -1 AS k FROM words UNION ALL SELECT word, n, substr(word, 1, k) || substr(word, k + 2), k FROM words, range((SELECT max(length(word)) FROM words)) r(k) WHERE k < length(word)),
 near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.word <> b.word AND (a.k = b.k OR a.k = -1 OR b.k = -1)),
 best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
 forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
 path AS (SELECT word, word AS root FROM forms UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL)
 SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM forms f JOIN path p ON p.word = f.word JOIN forms l ON l.word = p.root AND l.form IS NULL"""

#: The other operators hash, tokenize, learn or compress, which SQL cannot express; tests/llm has their counterparts.
ORACLE_SQL: dict[str, str] = {"op2_sharding": _FILL, "op11_hard_negatives": _MINED, "op12_spelling_variants": _VARIANTS}
