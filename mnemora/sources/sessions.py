"""Session stores of chat agents as Spark data sources: folders of transcripts, and SQLite files.

``transcripts``: JSON lines, one message a line, ``.jsonl`` or compressed ``.jsonl.zst`` / ``.zstd``.
``sqlite_sessions``: tables ``sessions`` and ``messages`` of SQLite files.

A file is a partition: it is opened where it is read and streamed, so memory is bounded by a line or a
batch of rows and not by a file. Lines that can't be read are counted, not lost without a trace: they
come as a row with ``bad`` set, the text null. Paths must be readable on every executor.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, session_id string, pos long, role string, content string, ts double, bad boolean"
#: Suffixes of transcripts.
PLAIN, PACKED = (".jsonl",), (".jsonl.zst", ".jsonl.zstd", ".zstd")


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _files(path: str, suffixes: tuple[str, ...]) -> list[File]:
    found = [path] if os.path.isfile(path) else [x for x in glob.iglob(os.path.join(path, "**", "*"), recursive=True) if x.endswith(suffixes) and os.path.isfile(x)]
    return [File(x) for x in sorted(found)]


def _session_of(path: str) -> str:
    name = os.path.basename(path)
    for suffix in sorted((*PLAIN, *PACKED), key=len, reverse=True):
        if name.endswith(suffix):
            return name[: -len(suffix)]
    return name


def text_of(content) -> str | None:
    """The text of a message: a string, or the text parts of a list of parts."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(p if isinstance(p, str) else p.get("text") or "" for p in content if isinstance(p, str) or isinstance(p, dict) and isinstance(p.get("text"), str))
    return None


def epoch(value) -> float | None:
    """Seconds since 1970 of a number (seconds or milliseconds) or an ISO time; else None."""
    from datetime import datetime, timezone

    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value) / 1000 if value > 1e11 else float(value)
    try:
        at = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()


class TranscriptReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.label = options["path"], options.get("source", "transcript")

    def partitions(self) -> list[File]:
        return _files(self.path, PLAIN + PACKED)

    def read(self, partition: File) -> Iterator[tuple]:
        import io
        import json

        with open(partition.path, "rb") as raw:
            if partition.path.endswith(PACKED):
                import zstandard

                stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            else:
                stream = raw
            lines, pos, session = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n"), 0, _session_of(partition.path)
            at = iter(lines)
            while True:
                try:
                    line = next(at)
                except StopIteration:
                    return
                except Exception:  # a damaged frame ends the file; what came before it is kept
                    yield self.label, session, pos, None, None, None, True
                    return
                if not line.strip():
                    continue
                try:
                    x = json.loads(line)
                    m = x.get("message") if isinstance(x.get("message"), dict) else x
                    role, text = m.get("role"), text_of(m.get("content"))
                    own = x.get("session_id") or x.get("sessionId") or session
                    ok = isinstance(role, str) and text is not None
                    row = (self.label, str(own), pos, role if ok else None, text if ok else None, epoch(x.get("timestamp", x.get("ts"))), not ok)
                except (ValueError, AttributeError):
                    row = (self.label, session, pos, None, None, None, True)
                yield row
                pos += 1


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.label = options["path"], options.get("source", "sqlite")

    def partitions(self) -> list[File]:
        return _files(self.path, (".db", ".sqlite", ".sqlite3"))

    def read(self, partition: File) -> Iterator[tuple]:
        import sqlite3

        c = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        try:
            c.text_factory = lambda b: b.decode("utf-8", "replace")
            names = {r[1] for r in c.execute("PRAGMA table_info(messages)")}
            if not names:
                yield self.label, None, None, None, None, None, True  # no table of messages
                return
            time = next((n for n in ("timestamp", "created_at", "ts") if n in names), "NULL")
            source = "(SELECT source FROM sessions s WHERE s.id = m.session_id)" if c.execute("SELECT 1 FROM sqlite_master WHERE name = 'sessions'").fetchone() else "NULL"
            last, pos = None, 0
            for session, role, content, at, own in c.execute(f"SELECT session_id, role, content, {time}, {source} FROM messages m ORDER BY session_id, rowid"):
                pos = pos + 1 if session == last else 0
                last = session
                ok = role is not None and content is not None
                yield own or self.label, None if session is None else str(session), pos, role if ok else None, str(content) if ok else None, epoch(at), not ok
        except sqlite3.DatabaseError:  # what was read before stays
            yield self.label, None, None, None, None, None, True
        finally:
            c.close()


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TranscriptReader(dict(self.options))


class SqliteSessions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_sessions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(dict(self.options))


def session_source(spark: SparkSession, kind: str, path: str, source: str | None = None) -> DataFrame:
    """The messages (and bad lines) of a store: kind is transcripts or sqlite_sessions; source labels
    its rows, where the store has no label of its own."""
    for s in (Transcripts, SqliteSessions):
        spark.dataSource.register(s)
    reader = spark.read.format(kind).option("path", path)
    return (reader.option("source", source) if source else reader).load()


def union_sessions(*stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages of several stores as one table (source, session_id, pos, role, content, ts), and the
    number of bad rows by source."""
    rows = stores[0]
    for s in stores[1:]:
        rows = rows.unionByName(s)
    return rows.filter("not bad").drop("bad"), rows.filter("bad").groupBy("source").agg(F.count(F.lit(1)).alias("bad"))
