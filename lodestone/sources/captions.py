"""Captions: cues of WebVTT and SRT texts as rows, and timed paragraphs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TIME = r"(\d{2}):(\d{2}):(\d{2})[.,](\d{3})\s*-->\s*\d{2}:\d{2}:\d{2}[.,]\d{3}"


def cues(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, cue, seconds, stamp and text: a cue is the lines from its time to the next blank line or time."""
    lines = files.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    part = lambda k: F.regexp_extract("line", _TIME, k)
    timed = F.col("line").rlike(_TIME)
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("cue", F.sum(F.when(timed | (F.col("line") == ""), 1).otherwise(0)).over(w))
    stamp = F.when(part(1).cast("int") > 0, F.concat(part(1).cast("int").cast("string"), F.lit(":"), part(2), F.lit(":"), part(3))).otherwise(F.concat(part(2), F.lit(":"), part(3)))
    seconds = part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")
    said = F.when(~timed & (F.col("line") != "") & ~F.col("line").rlike(r"(?i)^(WEBVTT|NOTE |KIND:|LANGUAGE:)|^\d+$"), F.trim(F.regexp_replace("line", r"<[^>]+>", "")))
    g = marked.groupBy(key, "cue").agg(F.max(F.when(timed, seconds)).alias("seconds"), F.max(F.when(timed, stamp)).alias("stamp"), F.sort_array(F.collect_list(F.when(said.isNotNull(), F.struct("n", said.alias("t"))))).alias("_t"))
    return g.where("seconds is not null and size(_t) > 0").select(key, "cue", "seconds", "stamp", F.array_join(F.transform("_t", lambda x: x["t"]), " ").alias("text"))


def transcript(found: DataFrame, key: str, window: int = 30) -> DataFrame:
    """key and text: a line for each window. A window opens with a cue and takes those that begin less than `window`
    seconds after it; a cue that only repeats the end of the one before is dropped. The fold runs over one file's cues."""
    rows = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("cue", "seconds", "stamp", "text"))).alias("c"))
    kind = "array<struct<seconds:int,stamp:string,said:array<string>>>"
    empty = F.array().cast(kind)

    def add(done, c):
        last = F.element_at(done, -1)
        fresh = (F.size(done) == 0) | (c["seconds"] - last["seconds"] >= window)
        new = F.concat(done, F.array(F.struct(c["seconds"].cast("int").alias("seconds"), c["stamp"].alias("stamp"), F.array(c["text"]).alias("said"))).cast(kind))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["seconds"].alias("seconds"), last["stamp"].alias("stamp"), F.concat(last["said"], F.array(c["text"])).alias("said"))).cast(kind))
        return F.when(fresh, new).when(F.element_at(last["said"], -1).endswith(c["text"]), done).otherwise(longer)

    line = lambda w: F.concat(F.lit("["), w["stamp"], F.lit("] "), F.array_join(w["said"], " "))
    return rows.select(key, F.array_join(F.transform(F.aggregate("c", empty, add), line), "\n").alias("text"))


def transcripts(videos: DataFrame, captions: DataFrame, notes: DataFrame) -> DataFrame:
    """videos (video_id, title, summary) with the best text there is: captions, else notes, else the summary."""
    joined = videos.join(captions.select("video_id", F.col("text").alias("_c")), "video_id", "left").join(notes.select("video_id", F.col("text").alias("_n")), "video_id", "left")
    source = F.when(F.col("_c").isNotNull(), "captions").when(F.col("_n").isNotNull(), "curated_note").otherwise("metadata_only")
    text = F.coalesce("_c", F.concat(F.lit("Curated notes, not a verbatim transcript.\n\n"), F.col("_n")), "summary", "title")
    return joined.select("video_id", "title", text.alias("text"), source.alias("transcript_source"), F.when(source == "captions", 1.0).otherwise(0.8).alias("authority_factor"))
