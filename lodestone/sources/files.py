"""Documents from folders of text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction, text as T

# Extensions read as text, names read without one, and languages by extension.
TEXT_EXTENSIONS = tuple("""
.md .markdown .mdx .rst .txt .adoc .org
.py .js .jsx .ts .tsx .mjs .cjs .go .rs .java .kt .kts .scala .rb .php .cs .swift
.c .h .cc .cpp .hpp .hh .m .mm .sh .bash .zsh .fish .ps1 .sql .r .jl .lua .pl .ex .exs
.html .css .scss .less .vue .svelte
.json .yaml .yml .toml .ini .cfg .conf .env.example .properties .gradle .tf .tfvars
.proto .graphql .gql .ipynb .dockerfile .mk .cmake .bzl
""".split())  # fmt: skip
TEXT_NAMES = ("dockerfile", "makefile", "license", "readme", "changelog", "contributing")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin",
    ".rb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".sh": "bash", ".bash": "bash",
    ".sql": "sql", ".md": "markdown", ".rst": "rst", ".html": "html", ".css": "css", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".tf": "terraform",
    ".proto": "protobuf", ".ipynb": "jupyter", ".lua": "lua", ".r": "r", ".jl": "julia",
}
# Folders of dependencies and build results, lock files, and generated files.
SKIPPED = (
    r"(?i)(^|/)(\.git|node_modules|vendor|third_party|dist|build|out|target|\.venv|venv|__pycache__|\.mypy_cache|\.pytest_cache|\.next|\.nuxt|coverage|htmlcov)(/|$)"
    r"|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|go\.sum|composer\.lock|Gemfile\.lock|uv\.lock|\.min\.(js|css))$"
    r"|\.(min|bundle|generated|pb|_pb2)\."
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def skip_reason(path: Column, length: Column, head: Column | None = None, most: int = 400_000, exclude: str | None = None) -> Column:
    """The first reason not to read a file, or "ok"."""
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    out = F.when(path.rlike(SKIPPED), "skip_pattern")
    if exclude:
        out = out.when(path.rlike(exclude), "excluded")
    out = out.when(length > most, "too_large").when(~(extension(path).isin(*TEXT_EXTENSIONS) | name.isin(*TEXT_NAMES)), "not_text")
    if head is not None:
        out = out.when(F.instr(F.hex(F.substring(head, 1, 8192)), "00") % 2 == 1, "binary")
    return out.otherwise("ok")


def read_folder(spark: SparkSession, root: str, pattern: str = "*", most: int = 400_000, exclude: str | None = None, authority: float = 1.0) -> DataFrame:
    """One row a text file under root: raw documents with redacted text, front matter and language."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.split("://")[-1].rstrip("/")
    relative = F.regexp_replace("path", "^.*?" + base.replace(".", r"\.") + "/", "")
    rows = files.select(relative.alias("path"), "length", "modificationTime", "content").where(skip_reason(F.col("path"), F.col("length"), F.col("content"), most, exclude) == "ok")
    text = redaction.redact(F.decode("content", "UTF-8"))
    front = T.front_matter(text)
    return rows.select(
        F.lit("filesystem").alias("source_system"), F.col("path").alias("external_id"), F.concat(F.lit("file://"), F.lit(base), F.lit("/"), "path").alias("uri"), F.regexp_extract("path", r"([^/]+)$", 1).alias("title"),
        T.without_front_matter(text).alias("text"), front.alias("front_matter"), language(F.col("path")).alias("language"), F.lit(authority).alias("authority"),
        F.coalesce(T.epoch_seconds(front["date"]), F.unix_micros("modificationTime") / 1e6).alias("source_updated_at"), F.lit("prose").alias("kind"),
    )


def read_goldens(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; blank lines and # comments are skipped, anything else malformed fails."""
    kind = "question string, expect_sources array<string>, expect_answer_contains array<string>, expect_abstain boolean, notes string, tags array<string>"
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("g")).select("g.*")
