"""Mergeable summaries of keys and sizes by command: made a day at a time, kept, and merged for any span of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import lines as L
from feedlens.operators.parse import parse, without_replies

#: Logarithm of the registers of a sketch of distinct keys: an error of about 0.8 percent; accuracy of the size sketches: about 0.4 percent of rank.
REGISTERS, ACCURACY = 14, 800


def daily(lines: DataFrame) -> DataFrame:
    """day, cmd, lines, keys (sketch of distinct first arguments), sizes (sketch of line lengths)."""
    rows = parse(without_replies(lines)).where("args_ok and event_time is not null")
    rows = rows.select(F.to_date("event_time").alias("day"), "cmd", L.to_bytes(F.get("args", F.lit(0))).alias("key"), F.octet_length("line").cast("long").alias("size"))
    return rows.groupBy("day", "cmd").agg(F.count(F.lit(1)).alias("lines"), F.hll_sketch_agg("key", REGISTERS).alias("keys"), F.kll_sketch_agg_bigint("size", ACCURACY).alias("sizes"))


def merged(days: DataFrame, *by: str) -> DataFrame:
    """Rows of daily(), of any days, as one row for each value of `by`, or in all."""
    return days.groupBy(*by).agg(F.sum("lines").alias("lines"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_bigint("sizes", ACCURACY).alias("sizes"))


def estimates(rows: DataFrame, *ranks: float) -> DataFrame:
    """Sketches as numbers: distinct_keys, and size_<percent> for each rank."""
    out = rows.withColumn("distinct_keys", F.hll_sketch_estimate("keys"))
    for r in ranks:
        out = out.withColumn(f"size_{round(100 * r)}", F.kll_sketch_get_quantile_bigint("sizes", F.lit(float(r))))
    return out.drop("keys", "sizes")
