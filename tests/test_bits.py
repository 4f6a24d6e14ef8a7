"""Names of bit masks."""

from pyspark.sql import functions as F

from feedlens.functions import bits


def test_names_take_the_mask_once(spark):
    """No function that runs once a name holds the mask's own expression, be it given in place or by a column."""
    keys = spark.createDataFrame([(k,) for k in range(50)], "source_key long")
    mask = F.expr("cast(source_key * 7919 % 1048576 as int)")
    in_place = keys.select(mask.alias("mask"), bits.names_of(mask, bits.FLAG_BITS).alias("n"))
    by_column = keys.select(mask.alias("mask")).select(bits.names_of(F.col("mask"), bits.FLAG_BITS).alias("n"))
    for frame in (in_place, by_column):
        first = frame._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
        before, inside = first.split("lambdafunction(", 1)
        assert "source_key" in before and "source_key" not in inside
    for row in in_place.collect():
        assert row.n == sorted(n for n, b in bits.FLAG_BITS.items() if row.mask & b)


def test_names_of_null_and_empty_masks(spark):
    rows = spark.createDataFrame([(0,), (None,), (1 << 19,)], "mask int").select("mask", bits.names_of(F.col("mask"), bits.FLAG_BITS).alias("n")).collect()
    assert {r.mask: r.n for r in rows} == {0: [], None: [], 1 << 19: ["wo", "write"]}
