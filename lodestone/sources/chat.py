"""Chat transcripts: JSON lines of turns, or tables of turns, as one document a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_markup


def sessions(turns: DataFrame, session: str, order: str = "turn", role: str = "role", text: str = "text", least: int = 2) -> DataFrame:
    """session, turns, and the text of all turns in order, for sessions of at least `least` turns."""
    line = F.concat(F.col(role), F.lit(": "), F.col(text))
    rows = turns.groupBy(session).agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct(order, role, line.alias("line")))).alias("_t"))
    return rows.where(F.col("turns") >= least).select(session, "turns", F.array_join(F.transform("_t", lambda x: x["line"]), "\n\n").alias("text"))


def rendered(content: Column, thinking: bool = False, results: bool = False, most: int = 400) -> Column:
    """Text of a message's content (JSON): a string, or blocks of which text is kept, tool uses are named, and thinking
    and tool results are kept on request."""
    kind = "array<struct<type:string,text:string,thinking:string,name:string,content:string,input:struct<description:string>>>"
    blocks = F.from_json(content, kind)
    one = lambda b: F.when(b["type"] == "text", strip_markup(b["text"])).when((b["type"] == "thinking") & F.lit(thinking), strip_markup(b["thinking"])).when(
        b["type"] == "tool_use", F.concat(F.lit("[used "), b["name"], F.coalesce(F.concat(F.lit(": "), b["input"]["description"]), F.lit("")), F.lit("]"))).when(
        (b["type"] == "tool_result") & F.lit(results), F.substring(strip_markup(b["content"]), 1, most))
    parts = F.filter(F.transform(blocks, one), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.substring(F.trim(content), 1, 1) == "[", F.array_join(parts, "\n")).otherwise(strip_markup(F.regexp_replace(content, r'^"|"$', "")))


def read_transcripts(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """Sessions from files of JSON lines, one file a session; lines that are no JSON or no turns are skipped."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select("value", F.col("_metadata.file_path").alias("session"))
    row = F.from_json("value", "type string, timestamp string, message struct<role:string>")
    parsed = lines.select("session", row.alias("r"), F.get_json_object("value", "$.message.content").alias("content")).where(F.col("r.type").isin("user", "assistant"))
    turns = parsed.select("session", F.col("r.timestamp").alias("turn"), F.coalesce("r.message.role", "r.type").alias("role"), rendered(F.col("content")).alias("text"))
    return sessions(turns.where("text <> ''"), "session", least=least)
