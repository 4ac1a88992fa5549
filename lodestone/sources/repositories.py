"""Repository records (JSON of a code host) as raw documents, by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import epoch_seconds
from .files import language

ISSUE = "struct<number:int,title:string,body:string,state:string,html_url:string,updated_at:string,user:struct<login:string>,labels:array<struct<name:string>>,pull_request:struct<url:string>>"
COMMIT = "struct<sha:string,html_url:string,commit:struct<message:string,author:struct<name:string,date:string>>>"
RELEASE = "struct<id:bigint,tag_name:string,name:string,body:string,html_url:string,published_at:string>"


def _document(rows: DataFrame, external_id, uri, title, text, kind, updated) -> DataFrame:
    return rows.select(F.lit("github").alias("source_system"), external_id.alias("external_id"), uri.alias("uri"), title.alias("title"), text.alias("text"), kind.alias("kind"), epoch_seconds(updated).alias("source_updated_at"))


def issues(records: DataFrame, repo: str, column: str = "value") -> DataFrame:
    r = records.select(F.from_json(column, ISSUE).alias("r")).where("r.number is not null")
    c = lambda name: F.col(f"r.{name}")
    kind = F.when(c("pull_request").isNotNull(), "pull_request").otherwise("issue")
    labels = F.array_join(F.transform("r.labels", lambda x: x["name"]), ", ")
    text = F.concat_ws("\n", F.concat(F.lit("# "), c("title")), F.concat(F.lit("State: "), c("state")), F.when(labels != "", F.concat(F.lit("Labels: "), labels)), F.lit(""), c("body"))
    return _document(r, F.concat(F.lit(f"{repo}#"), c("number").cast("string")), c("html_url"), c("title"), text, kind, c("updated_at"))


def commits(records: DataFrame, repo: str, column: str = "value") -> DataFrame:
    r = records.select(F.from_json(column, COMMIT).alias("r")).where("r.sha is not null")
    message = F.col("r.commit.message")
    return _document(r, F.concat(F.lit(f"{repo}@"), F.col("r.sha")), F.col("r.html_url"), F.split(message, "\n")[0], message, F.lit("commit"), F.col("r.commit.author.date"))


def releases(records: DataFrame, repo: str, column: str = "value") -> DataFrame:
    """Releases that say something; those without a body are dropped."""
    r = records.select(F.from_json(column, RELEASE).alias("r")).where("trim(coalesce(r.body, '')) <> ''")
    title = F.coalesce(F.nullif(F.col("r.name"), F.lit("")), F.col("r.tag_name"))
    return _document(r, F.concat(F.lit(f"{repo}:"), F.col("r.tag_name")), F.col("r.html_url"), title, F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("r.body")), F.lit("release"), F.col("r.published_at"))


def file_documents(blobs: DataFrame, repo: str, sha: str) -> DataFrame:
    """Blobs (path, content in base64) as documents whose address is pinned to a commit; binary ones are dropped."""
    text = F.decode(F.unbase64(F.col("content")), "UTF-8")
    rows = blobs.select("path", text.alias("t")).where(~F.col("t").contains("\x00"))
    return rows.select(F.lit("github").alias("source_system"), F.concat(F.lit(f"{repo}/"), "path").alias("external_id"), F.concat(F.lit(f"https://github.com/{repo}/blob/{sha}/"), "path").alias("uri"), F.col("path").alias("title"), F.col("t").alias("text"),
                       F.lit("file").alias("kind"), language(F.col("path")).alias("language"), F.col("path").rlike(r"(?i)(^|/)(tests?|specs?)(/|$)|(^|/)test_|_test\.").alias("is_test"))
