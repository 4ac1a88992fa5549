"""BM25 search of a batch of questions over a corpus.

Questions are written once and broadcast if their files are small: the corpus is read once and its tokens are filtered by
the questions' terms before anything is shuffled. What is left is dealt by document, once, for document frequencies as well:
term counts, scores of a document's matches and each partition's own best follow from that without a further shuffle of
matches; only k rows for each question and partition are dealt again by question.

A search over fields counts a row's matches in Arrow batches where its words lie: no token and no match is a row, and what is
dealt is one row a document with its terms' weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .staging import bounded, sized, small_side, staged

# Weights of a chunk's text, title and context header.
FIELDS = {"text": 1.0, "title": 0.6, "context_header": 0.4}
#: Rows of the corpus whose matches one task adds up, about: each may match every question.
TASK_ROWS = 2000
#: Rows whose matches are counted at once, and scores or shares of scores that are added up at once.
MATCH_ROWS, SCORES = 500, 2_000_000


def question_terms(questions: DataFrame, key: str, words: Column) -> DataFrame:
    return questions.select(key, F.explode(F.array_distinct(words)).alias("term"))


def counted(rows: DataFrame, keep: list[str], words: str) -> DataFrame:
    """The distinct words of each row's key with how often each occurs: keep, term, tf. Counts are combined where the rows
    lie, before they are shuffled. (Sorting and counting within a row took 12 s where this took 5.)"""
    return rows.select(*keep, F.explode(words).alias("term")).groupBy(*keep, "term").agg(F.count("*").cast("int").alias("tf"))


def bm25(docs: DataFrame, questions: DataFrame, doc: str, question: str, text: str = "text", question_text: str = "text",
         k1: float = 1.5, b: float = 0.75, words=T.tokens, positive: bool = True, question_words=None) -> DataFrame:
    """(question, doc, score) of all matches. positive: ln(1 + ...) as idf; else the plain one, floored at 1e-6. words
    gives the tokens of docs' text (which may be tokens already), question_words those of the questions'."""
    asked, hint = bounded(question_terms(questions, question, (question_words or words)(F.col(question_text))))
    prepared = docs.select(doc, words(F.col(text)).alias("_w")).withColumn("_len", F.size("_w"))
    about = prepared.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    matched = prepared.select(doc, "_len", F.explode("_w").alias("term")).join(hint(asked.select("term").distinct()), "term").repartition(doc)
    tf = matched.groupBy(doc, "term").agg(F.count("*").alias("_tf"), F.first("_len").alias("_len"))
    # one row for each of the questions' terms, and one for the corpus. Lengths are never null, and counted so that
    # frequencies and scores need the same columns: Spark then finds and deals the matches once for both
    df = hint(tf.groupBy("term").agg(F.count("_len").alias("_df")))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(about))
    n, d = F.col("_n"), F.col("_df")
    weight = F.ln(1 + (n - d + 0.5) / (d + 0.5)) if positive else F.greatest(F.lit(1e-6), F.ln((n - d + 0.5) / (d + 0.5)))
    part = weight * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return weighed.select(doc, "term", part.alias("_part")).join(hint(asked), "term").groupBy(question, doc).agg(F.sum("_part").alias("score"))


def plain_words(text: Column) -> Column:
    """Letters and digits in a row, lower-cased: compounds fall apart, nothing is a stopword."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass(frozen=True)
class FieldWords:
    """The words of each row's fields, made once for all searches of them: rows (key, _f: an array of words a field, _d: how
    many, _ok: whether a search may find it), the corpus' distinct words with their stems, and the fields' weights."""

    rows: DataFrame
    stems: DataFrame
    weights: tuple[float, ...]
    count: int
    average: float
    repeated: bool


def field_words(chunks: DataFrame, chunk: str, fields: dict[str, float] | None = None, stems: bool = True, only: Column | None = None) -> FieldWords:
    """only: which rows may be found; statistics are of all rows."""
    fields = fields or FIELDS
    each = F.array(*[plain_words(F.col(c)) for c in fields])
    ok = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    rows = staged(chunks.select(chunk, each.alias("_f"), ok.alias("_ok")).withColumn("_d", F.aggregate("_f", F.lit(0), lambda s, x: s + F.size(x))), "field-words")
    about = rows.agg(F.count("*").alias("n"), F.avg("_d").alias("d")).first()
    most = rows.groupBy(chunk).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # written before they are stemmed: else Spark infers a filter on stems, and stems every word of the corpus for it
    distinct = rows.select(F.explode(F.array_distinct(F.flatten("_f"))).alias("_word")).distinct()
    known = staged(staged(distinct, "distinct-words").withColumn("_stem", T.stem(F.col("_word"))), "stems") if stems else staged(distinct.withColumn("_stem", F.col("_word")), "distinct-words")
    return FieldWords(rows, known, tuple(fields.values()), about["n"], about["d"] or 0.0, most > 1)


def field_bm25(chunks: DataFrame, questions: DataFrame, chunk: str, question: str, fields: dict[str, float] | None = None,
               question_text: str = "text", k1: float = 1.2, b: float = 0.75, stems: bool = True, words: FieldWords | None = None, k: int | None = None) -> DataFrame:
    """(question, chunk, score) over several columns, each with a weight. Each of a question's distinct tokens is a phrase
    of its parts ("in-process": in, process), counted where the parts follow one another within a column. words: of the
    chunks, if they were made before (``field_words``). k: leave out rows that are not among a question's k best (6 digits).

    With stems, parts match by their Porter stems: the corpus' distinct words are stemmed once. Rows of one key are one
    document, scored by the length of each of them; rows without a key are not found.

    Questions' terms and the corpus' words that match them are held by tasks if their files are small; else words and
    matches are joined by shuffle."""
    w = words or field_words(chunks, chunk, fields, stems)
    stem = T.stem if stems else (lambda x: x)
    phrases = question_terms(questions, question, T.tokens(F.col(question_text))).withColumn("_parts", plain_words(F.col("term")))
    parts = phrases.select(question, "term", F.size("_parts").alias("_m"), F.posexplode("_parts").alias("_i", "_word"))
    asked, few = sized(parts.select(question, "term", "_m", "_i", stem(F.col("_word")).alias("_stem")))
    spoken = asked.select("_stem").distinct()
    known, little = sized(staged(w.stems.join(F.broadcast(spoken) if few else spoken, "_stem"), "side"))
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-w.count // TASK_ROWS))
    if few and little:
        return _field_scores(w, asked.toArrow(), known.toArrow(), asked.schema[question].dataType.simpleString(), chunk, question, k1, b, k, tasks)
    return _field_scores_dealt(w, asked, F.broadcast(known) if little else known, chunk, question, k1, b, tasks)


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each range, range by range."""
    return np.repeat(begin - _starts(many), many) + np.arange(many.sum())


def _field_scores(w: FieldWords, asked: pa.Table, known: pa.Table, asks: str, chunk: str, question: str, k1: float, b: float, k: int | None, tasks: int) -> DataFrame:
    """asks: the type of questions' keys."""
    spark, kind = w.rows.sparkSession, w.rows.schema[chunk].dataType.simpleString()
    schema = f"`{question}` {asks}, `{chunk}` {kind}, score double"
    if not asked.num_rows:
        return spark.createDataFrame([], schema)
    names, terms, stems = (pa.concat_arrays(asked.column(c).chunks).dictionary_encode(null_encoding="encode") for c in (question, "term", "_stem"))
    code = lambda c: c.indices.to_numpy().astype(np.int64)
    size, many, places = np.zeros(len(terms.dictionary), np.int64), len(terms.dictionary), asked.column("_i").to_numpy().astype(np.int64)
    size[code(terms)] = asked.column("_m").to_numpy()
    # of each stem the terms it is a part of, and where; of each term the questions that have it
    part = np.unique(np.stack([code(stems), code(terms), places]), axis=1)
    of_stem = np.bincount(part[0], minlength=len(stems.dictionary))
    pair = np.unique(np.stack([code(terms), code(names)]), axis=1)
    of_term = np.bincount(pair[0], minlength=many)
    words = pa.array(known.column("_word").to_pylist(), pa.string())
    at = np.array(pc.index_in(known.column("_stem"), value_set=stems.dictionary).to_pylist(), np.int64)
    weights, fields, longest = np.array(w.weights), len(w.weights), int(size.max())

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, MATCH_ROWS):
                rows = whole.slice(lo, MATCH_ROWS)
                texts = rows.column(1).flatten()
                length = pc.list_value_length(texts).to_numpy()
                found = texts.flatten().dictionary_encode()
                place = pc.fill_null(pc.index_in(found.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False)[found.indices.to_numpy()]
                hit = np.flatnonzero(place >= 0)
                slot, pos = np.repeat(np.arange(len(length)), length)[hit], (np.arange(len(place)) - np.repeat(_starts(length), length))[hit]
                stem = at[place[hit]]
                n = of_stem[stem]
                x = _spread(_starts(of_stem)[stem], n)
                slot, term, begin = np.repeat(slot, n), part[1][x], np.repeat(pos, n) - part[2][x]
                # a phrase is where all of its parts are
                one = size[term] == 1
                span = int(length.max(initial=0)) + longest
                starts, parts = np.unique((slot[~one] * many + term[~one]) * span + begin[~one] + longest - 1, return_counts=True)
                phrase, which = np.divmod(starts // span, many)
                kept = parts == size[which]
                slot, term = np.append(slot[one], phrase[kept]), np.append(term[one], which[kept])
                pairs, inverse = np.unique(slot // fields * many + term, return_inverse=True)
                f = np.bincount(inverse, weights[slot % fields], len(pairs))
                row, term = np.divmod(pairs, many)
                ends = pa.array(np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32))
                yield pa.record_batch({chunk: rows.column(0), "_ok": rows.column(2), "_t": pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), "_w": pa.ListArray.from_arrays(ends, pa.array(f.astype(np.float64))), "_l": pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32)), rows.column(3))})

    found = w.rows.select(chunk, "_f", "_ok", "_d").mapInArrow(matches, f"`{chunk}` {kind}, _ok boolean, _t array<int>, _w array<double>, _l array<int>")
    found = staged(found if w.repeated else found.where(F.size("_t") > 0), "matches")
    if w.repeated:
        each = found.select(chunk, F.explode(F.arrays_zip("_t", "_w")).alias("x")).groupBy(chunk, F.col("x._t").alias("t")).agg(F.sum("x._w").alias("w"))
        listed = each.groupBy(chunk).agg(F.collect_list(F.struct("t", "w")).alias("x")).select(F.col(chunk).alias("_key"), F.col("x.t").alias("_t"), F.col("x.w").alias("_w"))
        rows = found.groupBy(chunk).agg(F.max("_ok").alias("_ok"), F.flatten(F.collect_list("_l")).alias("_l"))
        found = staged(rows.join(listed, F.col(chunk).eqNullSafe(F.col("_key"))).select(chunk, "_ok", "_t", "_w", "_l"), "matches")
    df = np.zeros(many)
    for r in found.select(F.explode("_t").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator():
        df[r["t"]] = r["n"]
    idf = np.maximum(1e-6, np.log((w.count - df + 0.5) / (df + 0.5)))
    dictionary, questions, average = names.dictionary, len(names.dictionary), w.average

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((questions, k or 0), -np.inf)
        for rows in batches:
            t, f = (rows.column(c).flatten().to_numpy() for c in (1, 2))
            n, lengths = (pc.list_value_length(rows.column(c)).to_numpy().astype(np.int64) for c in (1, 3))
            d, first, first_length = rows.column(3).flatten().to_numpy(), np.append(0, np.cumsum(n)), _starts(lengths)
            shares = np.append(0, np.cumsum(of_term[t]))[first]
            lo = 0
            while lo < rows.num_rows:
                # as many rows as scores and their shares may be
                hi = max(lo + 1, min(rows.num_rows, lo + SCORES // questions, int(np.searchsorted(shares, shares[lo] + SCORES, "right")) - 1))
                terms, freq, owner = t[first[lo] : first[hi]], f[first[lo] : first[hi]], np.repeat(np.arange(hi - lo), n[lo:hi])
                # a share for each row of the key
                again = lengths[lo:hi][owner]
                x = np.repeat(np.arange(len(terms)), again)
                size = d[_spread(first_length[lo:hi][owner], again)]
                part = np.bincount(x, freq[x] / (freq[x] + k1 * (1 - b + b * size / average)), len(terms)) * idf[terms] * (k1 + 1)
                asking = of_term[terms]
                place = np.repeat(owner, asking) * questions + pair[1][_spread(_starts(of_term)[terms], asking)]
                score = np.bincount(place, np.repeat(part, asking), (hi - lo) * questions).reshape(hi - lo, questions)
                floor = np.zeros(questions)
                if k:
                    best = -np.partition(-np.concatenate([best, score.T], axis=1), k - 1, axis=1)[:, :k]
                    # what is less by more than a digit's half cannot be rounded to the k-th best's score
                    floor = best.min(axis=1) - 2e-6
                at_row, which = np.nonzero((score > 0) & (score >= floor))
                yield pa.record_batch({question: dictionary.take(pa.array(which)), chunk: rows.column(0).take(pa.array(at_row + lo)), "score": pa.array(score[at_row, which])})
                lo = hi

    scored = found.where(F.col("_ok") & F.col(chunk).isNotNull() & (F.size("_t") > 0)).select(chunk, "_t", "_w", "_l").repartition(tasks, chunk)
    return scored.mapInArrow(scores, schema)


def _field_scores_dealt(w: FieldWords, asked: DataFrame, known: DataFrame, chunk: str, question: str, k1: float, b: float, tasks: int) -> DataFrame:
    """The same by joins, for sides that no task holds."""
    rows = w.rows.withColumn("_row", F.monotonically_increasing_id())
    fields = rows.select("_row", chunk, F.posexplode("_f").alias("_field", "_ws")).withColumn("_weight", F.element_at(F.array(*[F.lit(x) for x in w.weights]), F.col("_field") + 1))
    tokens = fields.select("_row", chunk, "_field", "_weight", F.posexplode("_ws").alias("_pos", "_word"))
    placed = tokens.join(known, "_word").join(asked.select("term", "_m", "_i", "_stem").distinct(), "_stem").select("_row", chunk, "_field", "_weight", "term", "_m", (F.col("_pos") - F.col("_i")).alias("_start")).repartition(tasks, chunk)
    whole = placed.groupBy(chunk, "_row", "term", "_field", "_weight", "_start").agg(F.count("*").alias("_c"), F.first("_m").alias("_m")).where("_c = _m")
    f = whole.groupBy(chunk, "term").agg(F.sum("_weight").alias("_f"))
    df = f.groupBy("term").agg(F.count("*").alias("_df"))
    n, d = F.lit(w.count), F.col("_df")
    idf = F.greatest(F.lit(1e-6), F.ln((n - d + 0.5) / (d + 0.5)))
    allowed = rows.where(F.col(chunk).isNotNull()).groupBy(chunk).agg(F.max("_ok").alias("_ok"), F.collect_list("_d").alias("_l")).where("_ok")
    weighed = f.join(df, "term").join(allowed, chunk).withColumn("_d", F.explode("_l"))
    part = idf * F.col("_f") * (k1 + 1) / (F.col("_f") + k1 * (1 - b + b * F.col("_d") / w.average))
    return weighed.select(chunk, "term", part.alias("_part")).join(asked.select(question, "term").distinct(), "term").groupBy(question, chunk).agg(F.sum("_part").alias("score"))


def top(scored: DataFrame, by: list[str], k: int, doc: str, digits: int = 6) -> DataFrame:
    """The k best of each question: rounded score downward, then document. Spark keeps each partition's k best before it
    deals them by question."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), doc)
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
