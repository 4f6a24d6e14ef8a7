"""The fluent interface: read, filter, count, render."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession

from feedlens.operators import metadata, stats
from feedlens.operators.parse import parse, rejected, without_replies
from feedlens.plans import formats, serializers
from feedlens.plans.filters import LineFilter
from feedlens.sources import sink, text


@dataclass(frozen=True)
class Feed:
    """raw_lines and the command table that flags are looked up in; a table with source_id holds one for each source."""

    lines: DataFrame
    commands: DataFrame | None = None
    many: bool = False

    @classmethod
    def read(cls, spark: SparkSession, path: str, **source) -> Feed:
        return cls(text.read_lines(spark, path, **source))

    def union(self, *others: Feed) -> Feed:
        from feedlens.functions.addresses import union_all

        return replace(self, lines=union_all([self.lines, *(o.lines for o in others)]), many=True)

    def with_commands(self, table: DataFrame) -> Feed:
        return replace(self, commands=table)

    def filter(self, patterns: list[str] = (), flags: list[str] = (), db: int | None = None, seen: str | Observation | None = None) -> Feed:
        """Lines that pass; the command table is only joined where flags ask for it. `seen` counts all lines on the way, as stats.counted() does."""
        f = LineFilter.of(list(patterns), list(flags), db)
        if f.empty and seen is None:
            return self
        join = f.needs_metadata and self.commands is not None
        known = join or "cmd_flags" in self.lines.columns  # lines may carry what their server said
        rows = metadata.lookup(self.lines, self.commands, ["source_id"] if "source_id" in self.commands.columns else None) if join else self.lines
        rows = rows.where(f.column(metadata=known)) if seen is None else stats.counted(rows, f.column(metadata=known), seen)
        return replace(self, lines=rows.drop("cmd_flags", "cmd_categories") if join else rows)

    def stats(self, exact: bool = True) -> DataFrame:
        return stats.by_command(self.lines, compat=not exact)

    def parse(self) -> DataFrame:
        return parse(without_replies(self.lines))

    def rejects(self, structured: bool = False) -> DataFrame:
        return rejected(self.parse(), structured)

    def render(self, kind: str = "plain", format: str | None = None) -> DataFrame:
        if format is None:
            format = formats.MULTI if self.many else formats.SINGLE
        return serializers.render(self.parse(), kind, format)

    def save(self, path: str, kind: str = "plain", format: str | None = None, mode: str = "append") -> None:
        """Records below path and dead letters below path-rejects, in one pass."""
        self.lines.sparkSession.dataSource.register(sink.FeedOutput)
        if format is None:
            format = formats.MULTI if self.many else formats.SINGLE
        sink.outcome(self.parse(), kind, format).write.format("feed_output").option("kind", kind).mode(mode).save(path)

    def register(self, spark: SparkSession) -> None:
        """Temp views raw_lines, parsed_lines and, if known, commands."""
        self.lines.createOrReplaceTempView("raw_lines")
        self.parse().createOrReplaceTempView("parsed_lines")
        if self.commands is not None:
            self.commands.createOrReplaceTempView("commands")
