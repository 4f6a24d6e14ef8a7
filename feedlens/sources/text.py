"""Feed lines from text files, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions.lines import framed
from feedlens.functions.rows import once

SERVER = "struct<kind string, host string, port int, path string, ip string>"


def server_literal(kind: str = "unix", host: str | None = None, port: int | None = None, path: str | None = "stdin", ip: str | None = None):
    """A server as a constant column."""
    return F.struct(F.lit(kind).alias("kind"), F.lit(host).cast("string").alias("host"), F.lit(port).cast("int").alias("port"), F.lit(path).cast("string").alias("path"), F.lit(ip).cast("string").alias("ip"))


def as_lines(values: DataFrame, source_id: str = "stdin", server=None, name: str | None = None, seq=None, live: bool = False) -> DataFrame:
    """A column `value` (text or bytes) as raw_lines: source_id, server, name, seq, line."""
    rows = values.select(
        F.lit(source_id).alias("source_id"), (server_literal() if server is None else server).alias("server"), F.lit(name).cast("string").alias("name"),
        (F.monotonically_increasing_id() if seq is None else seq).cast("long").alias("seq"), F.col("value").cast("binary").alias("_value"),
    )
    return once(rows, "line", framed(F.col("_value"), live)).drop("_value")


def read_lines(spark: SparkSession, path: str, **source) -> DataFrame:
    """A replay: lines end with \\n only, a last line without one counts. seq follows file and offset."""
    return as_lines(spark.read.option("lineSep", "\n").text(path), **source)


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None, **source) -> DataFrame:
    """New files of a folder as a stream; max_files per trigger limits the rate."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return as_lines(reader.text(path), seq=F.lit(None), **source)
