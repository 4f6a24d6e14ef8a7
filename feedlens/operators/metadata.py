"""Command metadata: the table of commands, its loader, and the lookup by a line's command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import bits
from feedlens.functions import lines as L

#: Rows of a command table up to which it is broadcast; servers know some hundred commands.
BROADCAST_ROWS = 100_000


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _item(flat: Column, key: str) -> Column:
    """The value after a key in a flat array of JSON texts; keys are strings of any case, the first one counts."""
    keys = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1)), lambda i: F.struct(lower_ascii(F.get(flat, 2 * i)).alias("k"), F.get(flat, 2 * i + 1).alias("v")))
    return F.get(F.filter(keys, lambda x: x["k"] == key), F.lit(0))["v"]


def _array(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def _number(flat: Column, key: str) -> Column:
    return _item(flat, key).try_cast("long")


def _key_specs(rows: DataFrame) -> DataFrame:
    """rows (name_lc, specs: array of JSON texts) as name_lc, key_specs.

    A specification is a flat array of flags, begin_search and find_keys.
    """
    none = F.array().cast("array<string>")
    flat = rows.select("name_lc", F.posexplode("specs").alias("place", "spec")).withColumn("flat", _array(F.col("spec")))
    flat = flat.withColumns({k: _array(_item(F.col("flat"), k)) for k in ("flags", "begin_search", "find_keys")})
    flat = flat.withColumns({"bkind": lower_ascii(_item(F.col("begin_search"), "type")), "bspec": _array(_item(F.col("begin_search"), "spec")), "fkind": lower_ascii(_item(F.col("find_keys"), "type")), "fspec": _array(_item(F.col("find_keys"), "spec"))})
    flat = flat.withColumns({"keyword": _item(F.col("bspec"), "keyword")} | {k: _number(F.col(s), k) for s, k in (("bspec", "index"), ("bspec", "startfrom"), ("fspec", "lastkey"), ("fspec", "keystep"), ("fspec", "limit"), ("fspec", "keynumidx"), ("fspec", "firstkey"))})
    by_index, by_word = "bkind = 'index' and index is not null", "bkind = 'keyword' and keyword is not null and startfrom is not null"
    by_range, by_number = "fkind = 'range' and lastkey is not null and keystep is not null and limit is not null", "fkind = 'keynum' and keynumidx is not null and firstkey is not null and keystep is not null"
    only = lambda test, column: F.when(F.expr(test), F.col(column))
    made = flat.select("name_lc", F.struct(
        "place", bits.fold(F.coalesce("flags", none), bits.KEY_SPEC_BITS).alias("flags"),
        F.struct(F.when(F.expr(by_index), "index").when(F.expr(by_word), "keyword").otherwise("unknown").alias("kind"), only(by_index, "index").alias("index"), only(by_word, "keyword").alias("keyword"), only(by_word, "startfrom").alias("start_from")).alias("begin_search"),
        F.struct(
            F.when(F.expr(by_range), "range").when(F.expr(by_number), "keynum").otherwise("unknown").alias("kind"), only(by_range, "lastkey").alias("last_key"), only(f"({by_range}) or ({by_number})", "keystep").alias("key_step"),
            only(by_range, "limit").alias("limit"), only(by_number, "keynumidx").alias("keynum_idx"), only(by_number, "firstkey").alias("first_key"),
        ).alias("find_keys"),
    ).alias("s"))
    listed = made.groupBy("name_lc").agg(F.sort_array(F.collect_list("s")).alias("all"))
    return listed.select("name_lc", F.transform("all", lambda x: F.struct(x["flags"].alias("flags"), x["begin_search"].alias("begin_search"), x["find_keys"].alias("find_keys"))).alias("key_specs"))


def commands(replies: DataFrame, column: str = "reply") -> DataFrame:
    """The command table of reply rows, each a JSON array [name, arity, [flags], first, last, step, [categories], tips, [specs]].

    Rows of fewer than seven values, without a name or with numbers that are none are dropped; of rows with
    one name one stays.
    """
    at = lambda i: F.get("parts", F.lit(i))
    number = lambda i: F.when(at(i).rlike(r"\A-?[0-9]+\z"), at(i).try_cast("long"))
    empty = F.array().cast("array<string>")
    rows = replies.select(_array(F.col(column)).alias("parts")).where(F.size("parts") >= 7).select(
        at(0).alias("name"), lower_ascii(at(0)).alias("name_lc"), number(1).alias("arity"),
        bits.fold(F.coalesce(_array(at(2)), empty), bits.FLAG_BITS).alias("flags"), bits.fold(F.coalesce(_array(at(6)), empty), bits.CATEGORY_BITS).alias("categories"),
        number(3).alias("first_key"), number(4).alias("last_key"), number(5).alias("step_count"), F.coalesce(_array(at(8)), empty).alias("specs"),
    )
    rows = rows.dropna(subset=["name", "arity", "first_key", "last_key", "step_count"]).dropDuplicates(["name_lc"])
    return rows.join(_key_specs(rows), "name_lc", "left").select("name", "name_lc", "arity", "flags", "categories", "first_key", "last_key", "step_count", "key_specs")


def commands_by_source(replies: DataFrame) -> DataFrame:
    """What a lookup needs of rows (source_id, reply), with source_id: of rows of a source with one name one stays."""
    at, empty = lambda i: F.get("parts", F.lit(i)), F.array().cast("array<string>")
    rows = replies.select("source_id", _array(F.col("reply")).alias("parts")).where(F.size("parts") >= 7)
    masks = [bits.fold(F.coalesce(_array(at(i)), empty), known).alias(name) for i, known, name in ((2, bits.FLAG_BITS, "flags"), (6, bits.CATEGORY_BITS, "categories"))]
    return rows.select("source_id", lower_ascii(at(0)).alias("name_lc"), *masks).where("name_lc is not null").dropDuplicates(["source_id", "name_lc"])


def from_rows(spark: SparkSession, rows: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """A small table of (name, flags, categories)."""
    frame = spark.createDataFrame([(n, list(f), list(c)) for n, f, c in rows], "name string, f array<string>, c array<string>")
    return frame.select("name", lower_ascii(F.col("name")).alias("name_lc"), bits.fold(F.col("f"), bits.FLAG_BITS).alias("flags"), bits.fold(F.col("c"), bits.CATEGORY_BITS).alias("categories"))


def lookup(lines: DataFrame, table: DataFrame, on: list[str] | None = None) -> DataFrame:
    """lines with cmd_flags and cmd_categories, null where the command is unknown or missing.

    `on` names columns (such as source_id) by which tables of several servers differ. The table is broadcast
    when its size allows, else Spark picks the join.
    """
    name = lower_ascii(F.coalesce(L.command(F.col("line")), F.lit("")))
    side = table.select(F.col("name_lc").alias("_name"), F.col("flags").alias("cmd_flags"), F.col("categories").alias("cmd_categories"), *[F.col(c).alias(f"_{c}") for c in on or []])
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    rows = lines.withColumn("_cmd", name)
    test = F.col("_cmd") == F.col("_name")
    for c in on or []:
        test &= rows[c] == side[f"_{c}"]
    return rows.join(side, test, "left").drop("_cmd", "_name", *[f"_{c}" for c in on or []])
