"""Connectors: outside sources as Spark data sources, read whole or as a stream that goes on from its cursor.

A connector says what units its source has (a file, a session), each with a position, and reads one unit at a time:

    class Mine(Connector):
        system = "mine"
        def units(self): ...            # Unit(key, position, size)
        def fetch(self, unit): ...      # rows of RAW

``source_of`` makes a data source of it for spark.dataSource.register; then spark.read.format(name) reads all units and
spark.readStream.format(name) the units whose position is after the cursor, which is the stream's offset: a restarted query
goes on where its checkpoint ends. The driver only lists units. They are read in tasks, PARTITION_BYTES each, and a unit that
cannot be read gives a row with the reason in `skipped`, not a failed job.

Positions are (time, key): a unit that changes gets a later time and is read again. Units younger than `settle` seconds wait
for the next batch, since others of the same time may still come.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import redaction, text as T
from .files import SKIPPED, TEXT_EXTENSIONS, TEXT_NAMES, language

#: Raw documents as connectors give them.
RAW = "source_system string, external_id string, uri string, title string, text string, kind string, authority double, updated_at timestamp, skipped string"
PARTITION_BYTES = 32 << 20


@dataclass(frozen=True)
class Unit:
    key: str
    time: float
    size: int
    skipped: str | None = None

    @property
    def position(self) -> tuple[float, str]:
        return self.time, self.key


class Connector:
    """A source: its system's name, how much its documents count, what units it has and how one is read."""

    system = ""
    authority = 1.0

    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.authority = float(self.options.get("authority", self.authority))

    def units(self) -> Iterator[Unit]:
        raise NotImplementedError

    def fetch(self, unit: Unit) -> Iterator[tuple]:
        raise NotImplementedError

    def row(self, unit: Unit, uri: str, title: str, text: str | None, kind: str = "prose", skipped: str | None = None) -> tuple:
        return self.system, unit.key, uri, title, text, kind, self.authority, datetime.fromtimestamp(unit.time, timezone.utc), skipped


class Part(InputPartition):
    def __init__(self, units: list[Unit]):
        super().__init__(None)
        self.units = units


def _parts(units: list[Unit]) -> list[Part]:
    parts, size = [[]], 0
    for u in units:
        if parts[-1] and size + u.size > PARTITION_BYTES:
            parts.append([])
            size = 0
        parts[-1].append(u)
        size += u.size
    return [Part(p) for p in parts]


def _fetched(connector: Connector, units: list[Unit]) -> Iterator[tuple]:
    for u in units:
        if u.skipped:
            yield connector.row(u, u.key, u.key, None, skipped=u.skipped)
            continue
        try:
            yield from connector.fetch(u)
        except (OSError, ValueError):
            yield connector.row(u, u.key, u.key, None, skipped="unreadable")


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector):
        self.connector = connector

    def partitions(self) -> list[Part]:
        return _parts(sorted(self.connector.units(), key=lambda u: u.key))

    def read(self, partition: Part) -> Iterator[tuple]:
        return _fetched(self.connector, partition.units)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, connector: Connector):
        self.connector = connector
        self.settle = float(connector.options.get("settle", "0"))

    def _settled(self) -> list[Unit]:
        until = time.time() - self.settle
        return sorted((u for u in self.connector.units() if u.time <= until), key=lambda u: u.position)

    def initialOffset(self) -> dict:
        return {"time": -1.0, "key": ""}

    def latestOffset(self) -> dict:
        units = self._settled()
        return {"time": units[-1].time, "key": units[-1].key} if units else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after, upto = (start["time"], start["key"]), (end["time"], end["key"])
        return _parts([u for u in self._settled() if after < u.position <= upto])

    def read(self, partition: Part) -> Iterator[tuple]:
        return _fetched(self.connector, partition.units)


def source_of(connector: type[Connector], format_name: str) -> type[DataSource]:
    """A data source of a connector, to be registered: spark.dataSource.register(source_of(FolderConnector, "folder"))."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return RAW

        def reader(self, schema) -> DataSourceReader:
            return _Reader(connector(dict(self.options)))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(connector(dict(self.options)))

    return Source


def _matches(relative: str, pattern: str) -> bool:
    """A glob over folders: ** is any number of them, * and ? stay within one name."""
    here = re.escape(pattern).replace(r"\*\*/", "(?:[^/]+/)*").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.fullmatch(here, relative) is not None


class FolderConnector(Connector):
    """Text files under `path`. patterns: globs, comma separated (**/*); exclude: name patterns; max_bytes (400,000);
    follow_symlinks (false). Every folder and file on the way counts for symbolic links. Files that a pattern meets but that
    are not read (symlink, skip_pattern, excluded, too_large, not_text, binary) give a row that says so."""

    system = "filesystem"

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.root = os.path.abspath(self.options["path"].removeprefix("file://"))
        self.patterns = [p.strip() for p in self.options.get("patterns", "**/*").split(",") if p.strip()]
        self.exclude = [p.strip() for p in self.options.get("exclude", "").split(",") if p.strip()]
        self.most = int(self.options.get("max_bytes", 400_000))
        self.follow = self.options.get("follow_symlinks", "false").lower() == "true"

    def _reason(self, relative: str, linked: bool, size: int) -> str | None:
        name = relative.rpartition("/")[2].lower()
        if linked and not self.follow:
            return "symlink"
        if re.search(SKIPPED, relative):
            return "skip_pattern"
        if any(fnmatch.fnmatch(relative, p) for p in self.exclude):
            return "excluded"
        if size > self.most:
            return "too_large"
        if os.path.splitext(name)[1] not in TEXT_EXTENSIONS and name not in TEXT_NAMES:
            return "not_text"
        return None

    def units(self) -> Iterator[Unit]:
        seen = set()
        for folder, folders, names in os.walk(self.root, followlinks=self.follow):
            real = os.path.realpath(folder)
            if real in seen:  # a link back to where the walk has been
                folders.clear()
                continue
            seen.add(real)
            links = [] if self.follow else [f for f in folders if os.path.islink(f"{folder}/{f}")]
            for name in sorted(names + links):
                path = f"{folder}/{name}"
                relative = os.path.relpath(path, self.root).replace(os.sep, "/")
                if not any(_matches(relative, p) for p in self.patterns):
                    continue
                linked = os.path.islink(path)
                try:
                    about = os.lstat(path) if linked and not self.follow else os.stat(path)
                except OSError:
                    continue
                yield Unit(relative, about.st_mtime, about.st_size, self._reason(relative, linked, about.st_size))

    def fetch(self, unit: Unit) -> Iterator[tuple]:
        with open(f"{self.root}/{unit.key}", "rb") as f:
            raw = f.read()
        title = unit.key.rpartition("/")[2]
        if b"\0" in raw[:8192]:
            yield self.row(unit, f"file://{self.root}/{unit.key}", title, None, skipped="binary")
        else:
            yield self.row(unit, f"file://{self.root}/{unit.key}", title, raw.decode("utf-8", "replace"))


class ChatConnector(FolderConnector):
    """Chat sessions: files of JSON lines, each a turn with role and text (or content); a session of at least `least` turns
    (2) is one document of its turns in order. Lines that are no turns are passed over."""

    system = "chat"

    def __init__(self, options: dict[str, str]):
        super().__init__({"patterns": "**/*.jsonl", "max_bytes": str(64 << 20)} | {k.lower(): v for k, v in options.items()})
        self.least = int(self.options.get("least", 2))

    def _reason(self, relative: str, linked: bool, size: int) -> str | None:
        reason = super()._reason(relative, linked, size)
        return None if reason == "not_text" else reason

    def fetch(self, unit: Unit) -> Iterator[tuple]:
        turns = []
        with open(f"{self.root}/{unit.key}", encoding="utf-8", errors="replace") as f:
            for line in f:
                try:
                    turn = json.loads(line)
                except ValueError:
                    continue
                said = turn.get("text", turn.get("content")) if isinstance(turn, dict) else None
                if isinstance(said, str) and said.strip() and isinstance(turn.get("role"), str):
                    turns.append((turn["role"], said.strip()))
        if len(turns) < self.least:
            yield self.row(unit, f"file://{self.root}/{unit.key}", unit.key, None, "chat", skipped="too_short")
            return
        title = next((t for r, t in turns if r == "user"), turns[0][1]).split("\n")[0][:80]
        yield self.row(unit, f"file://{self.root}/{unit.key}", title, "\n\n".join(f"{r}: {t}" for r, t in turns), "chat")


def documents(raw: DataFrame) -> DataFrame:
    """What connectors read as raw documents of the library: redacted, without front matter, whose date wins over the
    file's time; skipped units are left out."""
    text = redaction.redact(F.col("text"))
    rows = raw.where("skipped is null").withColumn("text", text).withColumn("front_matter", T.front_matter(F.col("text")))
    dated = T.epoch_seconds(F.col("front_matter")["date"])
    return rows.select("source_system", "external_id", "uri", "title", T.without_front_matter(F.col("text")).alias("text"), "front_matter", language(F.col("external_id")).alias("language"), "authority", F.coalesce(dated, F.unix_micros("updated_at") / 1e6).alias("source_updated_at"), "kind")


def skipped_counts(raw: DataFrame) -> DataFrame:
    """How many units of each system were not read, by reason."""
    return raw.where("skipped is not null").groupBy("source_system", "skipped").agg(F.count("*").alias("units"))


def register(spark) -> None:
    """The connectors of this module as formats: lodestone_folder and lodestone_chat."""
    spark.dataSource.register(source_of(FolderConnector, "lodestone_folder"))
    spark.dataSource.register(source_of(ChatConnector, "lodestone_chat"))
