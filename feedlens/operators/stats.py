"""Counts and bytes by command, and counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from feedlens.functions import lines as L
from feedlens.functions.rows import once


def by_command(lines: DataFrame, compat: bool = False) -> DataFrame:
    """name, count, bytes of the lines that name a command, before any parsing.

    compat leaves the first line of each command out, as a counter does that is only created by it; it needs
    the column seq; (source_id, seq), or seq where there is no source_id, decides which line is first.
    """
    name = L.command_bytes(F.col("line"))
    order = ["source_id", "seq"] if compat and "source_id" in lines.columns else ["seq"] if compat else []
    text = F.when(F.is_valid_utf8("_name"), F.col("_name")).otherwise(F.lit("unknown"))
    rows = once(lines.select("line", *order), "_name", name).where("_name is not null")
    rows = rows.select(text.alias("name"), F.octet_length("line").cast("long").alias("size"), *order)
    size = F.sum("size")
    if compat:
        return rows.groupBy("name").agg((F.count(F.lit(1)) - 1).alias("count"), (size - F.min_by("size", F.struct(*order))).alias("bytes"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("count"), size.alias("bytes"))


def nonzero(stats: DataFrame) -> DataFrame:
    return stats.where("count > 0")


def _listed(stats: DataFrame) -> Column:
    return F.sort_array(F.collect_list(F.struct("name", "count", "bytes")))


def as_text(stats: DataFrame) -> DataFrame:
    """One row `value`: [stats]: name=[count, bytes], ... of the commands that occurred."""
    each = F.transform(_listed(nonzero(stats)), lambda s: F.concat(s["name"], F.lit("=["), s["count"].cast("string"), F.lit(", "), s["bytes"].cast("string"), F.lit("]")))
    return nonzero(stats).agg(F.concat(F.lit("[stats]: "), F.array_join(each, ", ")).alias("value"))


def as_json(stats: DataFrame) -> DataFrame:
    """One row `value`: a JSON array of {name, count, bytes}."""
    return stats.agg(F.to_json(_listed(stats)).alias("value"))


def as_php(stats: DataFrame) -> DataFrame:
    """One row `value`: the same as a PHP-serialized array."""
    number = lambda name, x: F.concat(F.lit(f's:{len(name)}:"{name}";i:'), x.cast("string"), F.lit(";"))
    item = lambda s: F.concat(F.lit('a:3:{s:4:"name";s:'), F.octet_length(s["name"]).cast("string"), F.lit(':"'), s["name"], F.lit('";'), number("count", s["count"]), number("bytes", s["bytes"]), F.lit("}"))
    each = F.transform(_listed(stats), lambda s, i: F.concat(F.lit("i:"), i.cast("string"), F.lit(";"), item(s)))
    return stats.agg(F.concat(F.lit("a:"), F.count(F.lit(1)).cast("string"), F.lit(":{"), F.array_join(each, ""), F.lit("}")).alias("value"))


def counters(lines: DataFrame, keep: Column) -> DataFrame:
    """One row: total lines and those that `keep` rejects."""
    return lines.agg(F.count(F.lit(1)).alias("total"), F.count_if(~keep).alias("filtered"))


def counted(lines: DataFrame, keep: Column, name: str | Observation = "io") -> DataFrame:
    """The lines that pass; the counters of all come with the action, without another scan.

    A batch takes an Observation, which has them when the action has ended; a stream a name, under which the
    progress of each micro-batch has them.
    """
    return lines.withColumn("_keep", keep).observe(name, F.count(F.lit(1)).alias("total"), F.count_if(~F.col("_keep")).alias("filtered")).where("_keep").drop("_keep")


def report(total: int, filtered: int, stalls: int = 0) -> str:
    return f"Processed {total} lines (filtered: {filtered}), backpressure stalls: {stalls}"
