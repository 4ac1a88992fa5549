"""From candidate lists to an ordering: fusion, features, expansion and diversification."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .staging import bounded, staged

# Weights of the reranking features.
WEIGHTS = {"fused": 1.0, "coverage": 0.45, "phrase": 0.25, "authority": 0.12, "recency": 0.0, "position": 0.15}


def fuse(arms: dict[str, DataFrame], question: str, doc: str, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (question, doc, rank) lists: a union and one aggregate, with each arm's rank and share.
    An arm of weight 0 still contributes its candidates."""
    parts = None
    for name, arm in arms.items():
        w = (weights or {}).get(name, 1.0)
        part = arm.select(question, doc, F.lit(name).alias("arm"), F.col("rank").cast("int").alias("rank"), (F.lit(w) / (k + F.col("rank"))).alias("share"))
        parts = part if parts is None else parts.unionByName(part)
    ranks = [F.max(F.when(F.col("arm") == a, F.col("rank"))).alias(f"{a}_rank") for a in arms]
    return parts.groupBy(question, doc).agg(F.sum("share").alias("score"), *ranks)


def longest_run(asked: Column, padded: Column) -> Column:
    """Length of the longest run of two or more consecutive question words that the text (words with spaces around)
    has in order."""
    # the text is a part of the state: in the step itself it would be made anew for each word
    begin = F.struct(F.lit(0).alias("best"), padded.alias("text"))

    def step(s: Column, end: Column) -> Column:
        words = F.concat(F.lit(" "), F.array_join(F.slice(asked, end - s["best"], s["best"] + 1), " "), F.lit(" "))
        return F.struct(F.when((end > s["best"]) & s["text"].contains(words), s["best"] + 1).otherwise(s["best"]).alias("best"), s["text"].alias("text"))

    # a run that ends at a word is at most one longer than one that ends at the word before
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(asked), F.lit(1))), begin, step, lambda s: s["best"])
    return F.when(best < 2, 0).otherwise(best)


def coverage(asked: Column, weights: Column, have: Column, power: int) -> Column:
    """Share of the question's weight, idf to a power, that the text's words cover."""
    pairs = F.arrays_zip(asked.alias("w"), weights.alias("i"))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.pow(p["i"], F.lit(power)))
    part = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when(F.array_contains(have, p["w"]), F.pow(p["i"], F.lit(power))).otherwise(0.0))
    return F.when(total > 0, part / total).otherwise(0.0)


def rerank(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """candidates with columns fused, asked and idfs (the question's distinct terms), sequence (its terms in order),
    words (the text's terms in order), authority, age_days and ordinal, and if there are any answerability and surface (of
    the question, ``question_facts``): features, relevance and the ordering score."""
    w = WEIGHTS | (weights or {})
    padded = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    df = candidates.withColumn("coverage", coverage(F.col("asked"), F.col("idfs"), F.col("words"), 2)).withColumn("gate_coverage", coverage(F.col("asked"), F.col("idfs"), F.col("words"), 1))
    df = df.withColumn("phrase", longest_run(F.col("sequence"), padded) / F.greatest(F.size("sequence"), F.lit(1)))
    df = df.withColumn("authority", F.greatest(F.lit(0.0), F.least(F.lit(1.5), F.coalesce("authority", F.lit(1.0)))) / 1.5)
    df = df.withColumn("recency", F.coalesce(F.exp(-F.col("age_days") / 365.0), F.lit(0.5))).withColumn("position", 1 / (1 + 0.15 * F.col("ordinal")))
    score = sum((F.col(name) * value for name, value in w.items()), F.lit(0.0))
    known = [F.col(c) for c in ("answerability", "surface") if c in candidates.columns]
    relevance = reduce(lambda a, b: a * b, known, 0.6 * F.col("gate_coverage") + 0.4 * F.col("phrase"))
    return df.withColumn("relevance", relevance).withColumn("score", score)


def _many_words(words: DataFrame, least: int) -> bool:
    """Whether there are `least` distinct words or more: mostly some of each partition tell, and the rest is not read."""
    return words.limit(10 * least).distinct().count() >= least or words.distinct().limit(least).count() >= least


def question_facts(docs: DataFrame, questions: DataFrame, question: str, words: str = "words", text: str = "text", least: int = 2000) -> DataFrame:
    """What reranking knows of each question: sequence (its words in order), asked and idfs (its distinct words, compounds
    that no document has in their parts; a word that no document has weighs most), answerability (the share of that
    weight which the corpus knows) and surface (the same over its words as they stand, parts of the corpus' compounds
    included). Both are 1 where the corpus has fewer than `least` distinct words. docs: words, an array.

    Questions are bounded and broadcast: of the corpus only counts of their words are made."""
    asked = questions.select(question, T.tokens(F.col(text)).alias("sequence"))
    distinct = asked.select(question, F.explode(F.array_distinct("sequence")).alias("term")).withColumn("parts", T.compound_parts(F.col("term")))
    distinct, hint = bounded(distinct)
    wanted = hint(distinct.select(F.explode(F.array_union(F.array("term"), "parts")).alias("term")).distinct())
    compound = lambda x: x.contains(".") | x.contains("-") | x.contains("/")
    here = docs.select(F.array_distinct(words).alias("_w")).withColumn("_p", F.array_distinct(F.flatten(F.transform(F.filter("_w", compound), T.compound_parts))))
    every = here.select(F.explode(F.concat(F.transform("_w", lambda x: F.struct(x.alias("term"), F.lit(1).alias("own"))), F.transform("_p", lambda x: F.struct(x.alias("term"), F.lit(0).alias("own"))))).alias("x")).select("x.*")
    known = hint(staged(every.join(wanted, "term").groupBy("term").agg(F.sum("own").alias("df")), "known-words"))
    large = _many_words(docs.select(F.explode(words).alias("term")), least)
    n = docs.agg(F.count("*").alias("_n"))

    def weighed(pairs: DataFrame) -> DataFrame:
        c = F.coalesce("df", F.lit(0))
        return pairs.join(known, "term", "left").crossJoin(F.broadcast(n)).withColumn("idf", F.round(F.ln(1 + (F.col("_n") - c + 0.5) / (c + 0.5)), 4)).withColumn("_has", c > 0)

    share = lambda has: F.when(F.lit(large) & (F.sum("idf") > 0), F.sum(F.when(has, F.col("idf")).otherwise(0.0)) / F.sum("idf")).otherwise(1.0)
    split = weighed(distinct).select(question, F.explode(F.when(F.col("_has") | (F.size("parts") == 0), F.array("term")).otherwise(F.col("parts"))).alias("term")).distinct()
    terms = weighed(split).groupBy(question).agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("_t"), share(F.col("_has")).alias("answerability"))
    spoken = weighed(asked.select(question, F.explode("sequence").alias("term"))).groupBy(question).agg(share(F.col("df").isNotNull()).alias("surface"))
    return asked.join(terms, question, "left").join(spoken, question, "left").select(question, "sequence", F.coalesce("_t.term", F.array().cast("array<string>")).alias("asked"), F.coalesce("_t.idf", F.array().cast("array<double>")).alias("idfs"), F.coalesce("answerability", F.lit(1.0)).alias("answerability"), F.coalesce("surface", F.lit(1.0)).alias("surface"))


def expansion_terms(feedback: DataFrame, question_terms: DataFrame, df: DataFrame, n: int, question: str, doc: str, most: int = 8, lift: float = 1.5) -> DataFrame:
    """Terms that tell the feedback documents (question, doc, words) from the corpus: in 40 % of them, of three letters
    or more, lift times as frequent as in the corpus (df: term, df); ordered by idf times log of their count."""
    size = feedback.groupBy(question).agg(F.countDistinct(doc).alias("_size"))
    counts = feedback.select(question, doc, F.explode(F.array_distinct("words")).alias("term")).groupBy(question, "term").agg(F.count("*").alias("_c"))
    counts = counts.join(question_terms.select(question, "term"), [question, "term"], "left_anti").where(F.length("term") >= 3)
    joined = counts.join(size, question).join(df, "term")
    share = F.col("_c") / F.col("_size")
    kept = joined.where((share >= 0.4) & (share / (F.col("df") / F.lit(float(n))) >= lift))
    scored = kept.withColumn("score", F.round(F.round(F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 4) * F.ln(1.0 + F.col("_c")), 6))
    w = Window.partitionBy(question).orderBy(F.desc("score"), F.desc("term"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(question, "term", "score", "rank")


def mmr(candidates: DataFrame, question: str, doc: str, k: int = 8, trade: float = 0.7, always: bool = True) -> DataFrame:
    """Greedy choice of k of each question's few candidates (question, doc, score, words): relevance against the largest
    Jaccard similarity to what is chosen already. Groups are the candidate lists, bounded by the candidate count. always: or else only of longer lists than k,
    while shorter ones stay in order of score."""
    kinds = f"`{question}` {candidates.schema[question].dataType.simpleString()}, `{doc}` {candidates.schema[doc].dataType.simpleString()}, score double, pick int"

    def choose(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["score", doc], ascending=[False, True], ignore_index=True)
        sets = [set(w) for w in df["words"]]
        alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        chosen: list[int] = [] if always or len(df) > k else list(range(len(df)))
        while len(chosen) < min(k, len(df)):
            best = max((i for i in range(len(df)) if i not in chosen), key=lambda i: (trade * df["score"][i] - (1 - trade) * max((alike(sets[i], sets[j]) for j in chosen), default=0.0), -i))
            chosen.append(best)
        out = df.loc[chosen, [question, doc, "score"]].reset_index(drop=True)
        out["pick"] = range(1, len(out) + 1)
        return out

    return candidates.select(question, doc, "score", "words").groupBy(question).applyInPandas(choose, kinds)

