"""robots.txt files as a table of rules, and admission of addresses by a join with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls


def rules(files: DataFrame, host: str = "host", text: str = "text") -> DataFrame:
    """(host, agent, allow, pattern, regex) of files (host, text). Consecutive user-agent lines share the rules after
    them; groups of one agent are one. * stands for anything, a last $ for the end of the path."""
    lines = files.select(host, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("n", "raw")).select(host, "n", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("line")).where(F.col("line").contains(":"))
    lines = lines.select(host, "n", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value")).where(F.col("field") != "sitemap")
    w = Window.partitionBy(host).orderBy("n")
    agent = F.col("field") == "user-agent"
    starts = agent & ~F.coalesce(F.lag("field").over(w) == "user-agent", F.lit(False))
    lines = lines.withColumn("group", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = lines.where(agent).select(host, "group", F.lower("value").alias("agent")).distinct()
    given = lines.where(F.col("field").isin("allow", "disallow") & (F.col("value") != "")).select(host, "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    ends = F.col("pattern").endswith("$")
    body = F.when(ends, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern"))
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"), F.when(ends, "$").otherwise(""))
    return agents.join(given, [host, "group"]).select(host, "agent", "allow", "pattern", regex.alias("regex")).distinct()


def allowed(addresses: DataFrame, table: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """addresses with `allowed`: of the rules for the most specific matching agent (else *), the longest pattern that
    matches the path decides, allow before disallow; without one, all is allowed. Rules are joined by host."""
    mine = table.where(F.lit(agent.lower()).contains(F.col("agent")) | (F.col("agent") == "*"))
    best = mine.groupBy("host").agg(F.max(F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))).alias("_best"))
    mine = mine.join(best, "host").where(F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")) == F.col("_best")).drop("agent", "_best")
    path = F.regexp_extract(F.col(url), r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    asked = addresses.withColumn("_path", F.when(path == "", "/").otherwise(path)).withColumn("_host", urls.host(F.col(url)))
    hits = asked.select(url, "_path", "_host").distinct().join(mine, F.col("_host") == F.col("host")).where(F.expr("_path rlike regex"))
    verdict = hits.groupBy(url).agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("v")).select(url, F.col("v.allow").alias("_v"))
    return asked.join(verdict, url, "left").select(*addresses.columns, F.coalesce("_v", F.lit(True)).alias("allowed"))


def access(status: Column, on_error: str = "deny"):
    """What a robots response says by itself: "rules", "allow" or "deny"."""
    return F.when(status.between(200, 299), "rules").when(status.isin(401, 403), "deny").when(status.between(400, 499), "allow").otherwise(on_error)
