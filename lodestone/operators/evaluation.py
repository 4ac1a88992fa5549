"""Retrieval metrics over ranked lists, leakage of questions into the corpus, and expectations that tell nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .patterns import containing
from .staging import bounded, running_sums, small_side, staged

#: Share of the least weight of a document that holds a question up to which terms are left out of the search for candidates.
KEY_SHARE = 0.5


def metrics(ranked: DataFrame, relevant: DataFrame, question: str, doc: str, k: int) -> DataFrame:
    """Per question of `relevant`: recall, precision and hit at k, reciprocal rank (at any rank) and nDCG at k.
    ranked: (question, doc, rank); relevant: (question, doc). An item earns its gain once, at its first rank."""
    wanted = relevant.select(question, doc).distinct()
    sizes = wanted.groupBy(question).agg(F.count("*").alias("_relevant"))
    first = ranked.groupBy(question, doc).agg(F.min("rank").alias("rank"))
    hits = first.join(wanted.withColumn("_hit", F.lit(1)), [question, doc], "left")
    at_k = F.col("rank") <= k
    gain = F.when(at_k & F.col("_hit").isNotNull(), F.ln(F.lit(2.0)) / F.ln(F.col("rank") + 1.0))
    per = hits.groupBy(question).agg(F.count(F.when(at_k, F.col("_hit"))).alias("_found"), F.count(F.when(at_k, 1)).alias("_shown"), F.min(F.when(F.col("_hit").isNotNull(), F.col("rank"))).alias("_first"), F.sum(gain).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.ln(F.lit(2.0)) / F.ln(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(per, question, "left").select(
        question,
        F.round(zero(F.col("_found") / F.col("_relevant")), 6).alias("recall"),
        F.round(zero(F.col("_found") / F.nullif(F.col("_shown"), F.lit(0))), 6).alias("precision"),
        F.coalesce(F.col("_found") > 0, F.lit(False)).alias("hit"),
        F.round(zero(1 / F.col("_first")), 6).alias("reciprocal_rank"),
        F.round(zero(F.col("_dcg") / ideal), 6).alias("ndcg"),
    )


def aggregate(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), *[F.round(F.avg(F.col(c).cast("double")), 4).alias(f"mean_{c}") for c in ("recall", "precision", "hit", "reciprocal_rank", "ndcg")])


def contamination(docs: DataFrame, questions: DataFrame, doc: str, question: str, words, text: str = "text",
                  verbatim: float = 0.85, overlap: float = 0.9, question_words=None, negative: str | None = None,
                  negative_verbatim: float = 0.5, negative_overlap: float = 0.6) -> DataFrame:
    """Documents that hold a question: (question, doc, kind, score). Kind is "verbatim" where a run of the question's
    words of at least a share `verbatim` of them is in the text, else "overlap" where the words in common have a share
    `overlap` of the question's idf. A term that is in no document has the largest idf.

    A document that holds a question has some least weight of its terms: a share `overlap` of all, or what the lightest
    run of enough words weighs. Candidates come from each question's rarest terms alone, as many as a document cannot lack
    all of; those whose terms met so far and all others together weigh too little are dropped as counts. The rest are
    compared, each as one row with both texts' words, by weight first; runs are looked for only where it suffices.
    questions are broadcast if they are small; words gives the tokens of docs' text (which may be tokens already)."""
    from .ranking import longest_run

    have = docs.select(doc, words(F.col(text)).alias("_words"))
    no = F.coalesce(F.col(negative), F.lit(False)) if negative else F.lit(False)
    floors = [F.when(no, F.lit(b)).otherwise(F.lit(a)).alias(name) for name, a, b in (("_run_floor", verbatim, negative_verbatim), ("_share_floor", overlap, negative_overlap))]
    asked = questions.select(question, (question_words or words)(F.col(text)).alias("_sequence"), *floors)
    terms = asked.select(question, "_run_floor", "_share_floor", F.size("_sequence").alias("_length"), F.explode(F.array_distinct("_sequence")).alias("term"))
    terms, hint = bounded(terms)
    wanted = hint(terms.select("term").distinct())
    df = have.select(F.explode(F.array_distinct("_words")).alias("term")).join(wanted, "term").groupBy("term").agg(F.count("*").alias("_df"))
    n = docs.agg(F.count("*").alias("_n"))
    c = F.coalesce("_df", F.lit(0))
    weighed = terms.join(hint(df), "term", "left").crossJoin(F.broadcast(n)).withColumn("idf", F.round(F.ln(1 + (F.col("_n") - c + 0.5) / (c + 0.5)), 4))
    each = Window.partitionBy(question)
    rarest = each.orderBy(F.desc("idf"), "term")
    ranked = weighed.withColumn("_total", F.sum("idf").over(each)).withColumn("_before", F.coalesce(F.sum("idf").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = staged(ranked, "question-weights")
    lightest = ranked.join(_lightest_runs(asked, ranked, question), question, "left")
    # greatest and least pass over nulls: without a run that is long enough only the share counts
    least = F.least(F.col("_share_floor") * F.col("_total"), "_lightest") * (1 - 1e-9) - 1e-6
    ranked = staged(lightest.withColumn("_least", least), "question-bounds")
    key = ranked.where(F.col("_before") <= F.col("_total") - KEY_SHARE * F.col("_least"))
    rest = key.groupBy(question).agg((F.first("_least") - F.first("_total") + F.sum("idf")).alias("_met"))
    met = have.select(doc, F.explode(F.array_distinct("_words")).alias("term")).join(hint(key.select(question, "term", "idf")), "term").groupBy(question, doc).agg(F.sum("idf").alias("_weight"))
    pairs = met.join(hint(rest), question).where(F.col("_weight") >= F.col("_met") - 1e-6).select(question, doc)
    facts = ranked.groupBy(question).agg(F.first("_total").alias("_total"), F.first("_least").alias("_least"), F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("_terms")).join(asked, question)
    full = have.join(small_side(pairs), doc).join(hint(facts), question)
    shared = F.aggregate(F.filter("_terms", lambda t: F.array_contains("_words", t["term"])), F.lit(0.0), lambda s, t: s + t["idf"])
    padded = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    run = longest_run(F.col("_sequence"), padded) / F.greatest(F.size("_sequence"), F.lit(1))
    scored = full.where(shared >= F.col("_least")).withColumn("_shared", shared).withColumn("_run", run).withColumn("_share", F.when(F.col("_total") > 0, F.col("_shared") / F.col("_total")).otherwise(0.0))
    kind = F.when(F.col("_run") >= F.col("_run_floor"), "verbatim").when(F.col("_share") >= F.col("_share_floor"), "overlap")
    return scored.withColumn("kind", kind).where("kind is not null").select(question, doc, "kind", F.round(F.when(F.col("kind") == "verbatim", F.col("_run")).otherwise(F.col("_share")), 6).alias("score"))


def _lightest_runs(asked: DataFrame, weights: DataFrame, question: str) -> DataFrame:
    """(question, _lightest): the least weight of distinct terms in any stretch of as many words as a run needs. A word
    counts in the stretches that begin after its last occurrence: sums of what comes and goes at each beginning."""
    size = F.size("_sequence")
    needed = F.greatest(F.ceil(size * F.col("_run_floor") - 1e-9), F.lit(1)).cast("int")
    rows = asked.select(question, "_sequence", needed.alias("_needed"), F.posexplode("_sequence").alias("_at", "term"))
    rows = rows.join(weights.groupBy(question, "term").agg(F.max("idf").alias("idf")), [question, "term"])
    last = F.lag("_at").over(Window.partitionBy(question, "_sequence", "term").orderBy("_at"))
    begin = F.greatest(F.coalesce(last + 1, F.lit(0)), F.col("_at") - F.col("_needed") + 1)
    change = F.array(F.struct(begin.alias("at"), F.col("idf").alias("w")), F.struct((F.col("_at") + 1).alias("at"), (-F.col("idf")).alias("w")))
    changes = rows.select(question, "_sequence", "_needed", change.alias("c")).select(question, "_sequence", "_needed", F.explode("c").alias("c")).groupBy(question, "_sequence", "_needed", "c.at").agg(F.sum("c.w").alias("w"))
    upto = Window.partitionBy(question, "_sequence").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("w", F.sum("w").over(upto)).where(F.col("at") <= size - F.col("_needed")).groupBy(question).agg(F.min("w").alias("_lightest"))


def fatal_findings(found: DataFrame, questions: DataFrame, docs: DataFrame, question: str, doc: str, negative: str, expected: str, blob: str) -> DataFrame:
    """found (question, doc, kind, score) with `fatal`: whether the document has to be held out for the question. Whatever
    is found for a negative one is; else a verbatim run is fatal in a document that is not among those the question
    expects (whose blob has one of the expected substrings, case aside), if it expects any: the expected source that holds
    the question holds its answer, any other one only talks of it."""
    side = small_side(questions.select(question, F.coalesce(F.col(negative), F.lit(False)).alias("_no"), F.coalesce(F.col(expected), F.array().cast("array<string>")).alias("_e")))
    rows = small_side(found).join(docs.select(doc, F.lower(F.coalesce(F.col(blob), F.lit(""))).alias("_b")), doc).join(side, question)
    wanted = F.exists("_e", lambda e: F.col("_b").contains(F.lower(e)))
    return rows.withColumn("fatal", F.col("_no") | ((F.col("kind") == "verbatim") & (F.size("_e") > 0) & ~wanted)).drop("_no", "_e", "_b")


def contamination_report(findings: DataFrame, questions: DataFrame, question: str) -> DataFrame:
    """One row: questions checked, those with a fatal finding, findings that are not fatal, and whether there is none."""
    n = questions.agg(F.count("*").alias("questions_checked"))
    one = findings.agg(F.countDistinct(F.when(F.col("fatal"), F.col(question))).alias("contaminated_questions"), F.count_if(~F.col("fatal")).alias("informational_findings"))
    return n.crossJoin(F.broadcast(one)).withColumn("clean", F.col("contaminated_questions") == 0)


def contamination_by_source(found: DataFrame, docs: DataFrame, question: str, doc: str, source: str) -> DataFrame:
    """For each source: distinct questions found in it, its documents that hold one, and pairs of both."""
    held = found.join(docs.select(doc, source), doc)
    return held.groupBy(source).agg(F.countDistinct(question).alias("questions"), F.countDistinct(doc).alias("documents"), F.count("*").alias("pairs"))


def report(cases: DataFrame) -> DataFrame:
    """One row for a run. cases: expect_abstain, abstained, passed, coverage (of citations), and a case's metrics, null
    where it is not graded. Metrics are over graded cases; citations over graded ones that were answered."""
    graded = ~F.col("expect_abstain")
    over = lambda c, when: F.round(F.avg(F.when(when, F.col(c).cast("double"))), 4)
    return cases.agg(
        F.count("*").alias("cases"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), F.round(F.avg(F.col("abstained").cast("double")), 4).alias("abstention_rate"),
        F.count(F.when(F.col("expect_abstain") & ~F.col("abstained"), 1)).alias("answered_negatives"), F.count(F.when(graded & F.col("abstained"), 1)).alias("refused_positives"),
        over("coverage", graded & ~F.col("abstained")).alias("citation_coverage"), *[over(c, graded).alias(f"mean_{c}") for c in ("recall", "precision", "hit", "reciprocal_rank", "ndcg")],
    )


def discrimination(docs: DataFrame, expectations: DataFrame, blob: str, expectation: str, share: float = 0.2) -> DataFrame:
    """How many documents each expected substring matches, case aside; "nothing" for none, "broad" beyond a share of all.
    All substrings are looked for at once, however many they are (``patterns``)."""
    distinct = staged(expectations.select(expectation, F.lower(F.col(expectation)).alias("_low")).distinct(), "expectations")
    n = docs.agg(F.count("*").alias("total"))
    matched = containing(docs.select(F.lower(F.col(blob)).alias("_b")), "_b", "_b", distinct, "_low", counts=True)
    out = distinct.join(matched, "_low", "left").crossJoin(F.broadcast(n)).drop("_low").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return out.withColumn("kind", F.when(F.col("matched") == 0, "nothing").when(F.col("matched") > share * F.col("total"), "broad").otherwise("fine"))


def first_expectation(retrieved: DataFrame, expected: DataFrame, question: str, blob: str) -> DataFrame:
    """For each retrieved row the first expected substring, in the golden's order, that it holds; else null."""
    joined = retrieved.join(small_side(expected), question, "left")
    return joined.withColumn("matched", F.element_at(F.filter("expect_sources", lambda e: F.lower(F.col(blob)).contains(F.lower(e))), 1))


def quarantined(ranked: DataFrame, contaminated: DataFrame, question: str, doc: str) -> DataFrame:
    """ranked without each question's own contaminated documents; others still see them."""
    return ranked.join(contaminated.select(question, doc).distinct(), [question, doc], "left_anti")


def auc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties counting half, from counts by score: no pairs are formed, and
    scores are added up range by range."""
    by = scored.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    below = running_sums(by, score, {"_below": "n"}, inclusive=False)
    return below.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), (F.sum(F.col("p") * (F.col("_below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc")).select("positives", "negatives", F.round(F.coalesce("auc", F.lit(0.5)), 6).alias("auc"))


def floors(scored: DataFrame, score: str, positive: str, digits: int = 2) -> DataFrame:
    """For each floor (the rounded scores that occur): positives below it and negatives at or above it. Scores are rounded
    as the numbers they are, not as they are written: 0.285 is less than half a step above 0.28."""
    steps = float(10**digits)
    by = scored.groupBy((F.round(F.col(score).cast("double") * steps) / steps).alias("floor")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    sums = running_sums(by, "floor", {"refused_positives": "p", "_answered": "n"}, inclusive=False)
    total = by.agg(F.sum("n").alias("_all"))
    out = sums.crossJoin(F.broadcast(total)).withColumn("answered_negatives", F.col("_all") - F.col("_answered"))
    return out.select("floor", "refused_positives", "answered_negatives", (F.col("refused_positives") + F.col("answered_negatives")).alias("errors"))


def signals(ranked: DataFrame, question: str) -> DataFrame:
    """Abstention signals of each question's list: best and mean score, margins to the second and the fifth."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    g = ranked.groupBy(question).agg(F.max("score").alias("top"), F.avg("score").alias("mean"), at(2).alias("_2"), F.min(F.when(F.col("rank") <= 5, F.col("score"))).alias("_5"))
    return g.select(question, F.round("top", 6).alias("top"), F.round("mean", 6).alias("mean"), F.round(F.coalesce(F.col("top") - F.col("_2"), F.lit(0.0)), 6).alias("margin"), F.round(F.coalesce((F.col("top") - F.col("_2")) / F.col("top"), F.lit(0.0)), 6).alias("relative_margin"), F.round(F.col("top") - F.col("_5"), 6).alias("margin_5"))


def redundancy(ranked: DataFrame, docs: DataFrame, question: str, doc: str, words) -> DataFrame:
    """Mean and median Jaccard similarity between the documents of each question's short list."""
    lists = ranked.select(question, doc).join(docs.select(doc, F.array_distinct(words(F.col("text"))).alias("w")), doc)
    a, b = lists.select(question, F.col(doc).alias("a"), F.col("w").alias("wa")), lists.select(question, F.col(doc).alias("b"), F.col("w").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    j = F.when((F.size("wa") == 0) | (F.size("wb") == 0), 0.0).otherwise(both / (F.size("wa") + F.size("wb") - both))
    return a.join(b, question).where("a < b").select(question, j.alias("j")).groupBy(question).agg(F.count("*").alias("pairs"), F.round(F.avg("j"), 6).alias("mean"), F.round(F.median("j"), 6).alias("median"))


def cooccurrence(docs: DataFrame, question_terms: DataFrame, question: str, doc: str, words, rarity: float = 0.2) -> DataFrame:
    """For each question the largest share of its rare terms (in at most a share of the documents) in one document."""
    question_terms, hint = bounded(question_terms)
    tf = docs.select(doc, F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(hint(question_terms.select("term").distinct()), "term")
    n = docs.agg(F.count("*").alias("n"))
    rare = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where(F.col("df") <= F.col("n") * rarity).select("term")
    kept = question_terms.join(hint(rare), "term")
    size = kept.groupBy(question).agg(F.count("*").alias("terms"))
    best = tf.join(hint(kept), "term").groupBy(question, doc).agg(F.count("*").alias("c")).groupBy(question).agg(F.max("c").alias("best"))
    return size.join(best, question).select(question, "terms", F.round(F.col("best") / F.col("terms"), 6).alias("share"))
