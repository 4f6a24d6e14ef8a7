"""Rendered records as a sink, by Spark's Python data source API, in batch and as a stream.

Rows with a value are written one after another as the output kind has them, the others as dead letters, both in
one pass over the rows. Tasks write hidden files; the commit of the batch gives them their names, all of a batch at
once. A task that dies or is run twice leaves nothing behind: what no commit message names goes.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from feedlens.operators.parse import dead_letters
from feedlens.plans import serializers
from feedlens.sources.files import Folder

SCHEMA = "value binary, source_id string, seq bigint, line binary, error string, message string"
#: What follows a record: its own bytes end a RESP record.
ENDS = {"plain": b"\n", "json": b"\n", "php": b"\n", "csv": b"\n", "resp": b""}


def outcome(parsed: DataFrame, kind: str = "plain", format: str | None = None) -> DataFrame:
    """The sink's rows of parsed lines, in one pass over them: a value, or the line with its error."""
    rows = serializers.values(dead_letters(parsed, serializers.kind_of(kind) != "plain"), kind, format)
    bad = F.col("error").isNotNull()
    return rows.select("value", "source_id", "seq", F.when(bad, F.col("line")).alias("line"), "error", "message")


@dataclass
class Written(WriterCommitMessage):
    """The hidden files of a task, below the path, and how many records and dead letters they hold."""

    lines: str | None
    rejects: str | None
    written: int
    rejected: int


class _Writer:
    """What batch and stream share. path holds records, path-rejects dead letters; what is not committed lies in path/_work-x.

    A path belongs to one writer at a time.
    """

    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), serializers.kind_of(options.get("kind", "plain"))
        self.work = f"_work-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        folder, name, end = Folder(self.path), uuid.uuid4().hex, ENDS[self.kind]
        folder.fs.create_dir(folder.at(self.work), recursive=True)
        files, counts = {}, {"lines": 0, "rejects": 0}

        def out(what: str):
            if what not in files:
                files[what] = folder.fs.open_output_stream(folder.at(f"{self.work}/{what}-{name}"))
            return files[what]

        try:
            for batch in iterator:
                column = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
                values = column["value"].drop_null().to_pylist()
                if values:
                    out("lines").write(end.join(values) + end)
                    counts["lines"] += len(values)
                if column["value"].null_count:
                    keep = column["value"].is_null()
                    rows = [column[c].filter(keep).to_pylist() for c in ("source_id", "seq", "line", "error", "message")]
                    for source, seq, line, error, message in zip(*rows, strict=True):
                        out("rejects").write(json.dumps({"source_id": source, "seq": seq, "line": base64.b64encode(line or b"").decode(), "error": error, "message": message}, ensure_ascii=False).encode() + b"\n")
                    counts["rejects"] += len(rows[0])
        finally:
            for file in files.values():
                file.close()
        return Written(*(f"{self.work}/{what}-{name}" if what in files else None for what in counts), *counts.values())

    def _publish(self, messages: list[Written | None], batch: str) -> None:
        """Give the files of a batch their names: `batch` below path and path-rejects, in place of what is there."""
        folder, rejects = Folder(self.path), Folder(f"{self.path}-rejects")
        sound = [m for m in messages if m is not None]
        for what, home, ending in (("rejects", rejects, "json"), ("lines", folder, "txt")):
            stage = f"_work-{uuid.uuid4().hex}"
            home.fs.create_dir(home.at(stage), recursive=True)
            for i, name in enumerate(n for m in sound if (n := getattr(m, what))):
                folder.fs.move(folder.at(name), home.at(f"{stage}/part-{i:05}.{ending}"))
            home.put_json(f"{stage}/_SUCCESS", {"written": sum(m.written for m in sound), "rejected": sum(m.rejected for m in sound)})
            home.remove(batch)
            home.move(stage, batch)
        self._drop()

    def _drop(self) -> None:
        """Forget all that no batch has."""
        for path in (self.path, f"{self.path}-rejects"):
            folder = Folder(path)
            for name in folder.names():
                if name.startswith("_work-"):
                    folder.remove(name)


class BatchWriter(_Writer, DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options)
        self.overwrite = overwrite

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for path in (self.path, f"{self.path}-rejects"):
                folder = Folder(path)
                for name in folder.names():
                    if not name.startswith("_work-"):
                        folder.remove(name)
        self._publish(messages, f"batch={uuid.uuid4().hex}")

    def abort(self, messages: list) -> None:
        self._drop()


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    """A batch that is repeated takes the place of what it wrote before."""

    def commit(self, messages: list, batchId: int) -> None:
        self._publish(messages, f"batch={batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self._drop()


class FeedOutput(DataSource):
    """outcome(...).write.format("feed_output").option("kind", "resp").save(path), or writeStream with a path."""

    @classmethod
    def name(cls) -> str:
        return "feed_output"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options))
