"""Sources: instances and clusters as tables of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions.addresses import server_address


def nodes(slots: DataFrame) -> DataFrame:
    """Primaries of slot rows (start, end, nodes[struct<host, port, id>]) with their replicas.

    Rows without nodes and malformed nodes are left out. A node is known by its address; of several ranges
    of a primary the one with the least start counts.
    """
    sound = F.filter("nodes", lambda n: n["host"].isNotNull() & n["port"].between(0, 65535) & n["id"].isNotNull())
    rows = slots.where(F.size("nodes") > 0).select("start", F.get("nodes", F.lit(0)).alias("primary"), F.filter(F.slice(sound, 2, F.greatest(F.size(sound), F.lit(1))), lambda n: n != F.get("nodes", F.lit(0))).alias("replicas"))
    rows = rows.where("primary.host is not null and primary.port between 0 and 65535 and primary.id is not null")
    return rows.groupBy(F.col("primary.host").alias("host"), F.col("primary.port").alias("port")).agg(F.min_by(F.col("primary.id"), "start").alias("id"), F.min_by("replicas", "start").alias("replicas"))


def members(primaries: DataFrame, replicas: bool = False) -> DataFrame:
    """One row per server to read: id, host, port, role; replicas only where asked for, each address once."""
    own = primaries.select("id", "host", "port", F.lit("primary").alias("role"))
    if replicas:
        more = primaries.select(F.explode("replicas").alias("r")).select(F.col("r.id").alias("id"), F.col("r.host").alias("host"), F.col("r.port").cast(dict(own.dtypes)["port"]).alias("port"), F.lit("replica").alias("role"))
        own = own.unionByName(more)
    return own.groupBy("host", "port").agg(F.min_by("id", "role").alias("id"), F.min("role").alias("role")).select("id", "host", "port", "role")


def resolve(instances: DataFrame, config: DataFrame) -> DataFrame:
    """instances (instance) as sources: the entry of that name, one row for each of its addresses, else the text as an address.

    config has (name, host, port, addresses, path, user, pass). Host and port come first, then addresses, then
    the path. Sources with one address count once.
    """
    entry = config.select(F.col("name").alias("_name"), "host", "port", "addresses", "path", "user", "pass")
    rows = instances.join(entry, F.col("instance") == F.col("_name"), "left")
    own = F.when(F.col("host").isNotNull() & F.col("port").isNotNull(), F.array(F.concat("host", F.lit(":"), F.col("port").cast("string"))))
    texts = F.when(F.col("_name").isNull(), F.array("instance")).otherwise(F.coalesce(own, F.col("addresses"), F.when(F.col("path").isNotNull(), F.array("path")), F.array().cast("array<string>")))
    rows = rows.select(F.col("_name").alias("name"), F.explode(texts).alias("text"), "user", "pass")
    rows = rows.withColumn("address", server_address(F.col("text"))).where("address.kind <> 'error'")
    key = F.struct("address.kind", "address.host", "address.port", "address.path")
    return rows.withColumn("_key", key).dropDuplicates(["_key"]).select("name", "address", "user", "pass")
