"""The queries over synthesised feeds, and the same in SQL for an independent engine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.engine import Feed
from feedlens.functions import addresses, bits
from feedlens.functions import lines as L
from feedlens.operators import metadata, sketches, stats, topology, windows
from feedlens.operators.parse import accepted, parse, rejected, without_replies
from feedlens.plans import formats, serializers
from feedlens.plans.filters import LineFilter
from feedlens.sources.text import as_lines, read_lines, server_literal, stream_lines
from feedlens.streaming.feed import stats_query

# ---------------------------------------------------------------- the feeds, in Spark

_LINE = """concat(cast(us div 1000000 as string), '.', lpad(cast(us % 1000000 as string), 6, '0'), ' [', cast(user_id % 16 as string), ' ',
  case event_id % 5 when 0 then concat('127.0.0.1:', cast(49152 + user_id as string)) when 1 then concat('[2001:db8::', cast(user_id % 10 as string), ']:', cast(40000 + user_id as string))
    when 2 then concat('unix:/run/app/u', cast(user_id as string), '.sock') when 3 then 'lua' else '' end,
  '] "', case event_type when 'view' then 'GET' when 'click' then 'INCR' when 'purchase' then 'SET' when 'signup' then 'HSET' else 'EVALSHA' end,
  '" "user:', cast(user_id as string), '" "', props, '"')"""

#: Ways to spoil a line of event_id % 17 = i: pattern, replacement, and the error it must give.
SPOILED = (
    (r"^", "x", "grammar"), (r"^[0-9]+", "99999999999999999999", "number out of range"), (r"\[[0-9]+ ", "[29999999999999999999 ", "number out of range"), (r'\[([0-9]+) [^"]*\] ', "[$1 7.300.2.1:9] ", "client address"),
    (r'\[([0-9]+) [^"]*\] ', "[$1 7.30.2.1:70000] ", "client address"), (r'\[([0-9]+) [^"]*\] ', "[$1 [fe80::zz]:9] ", "client address"), (r'"([A-Z]+)"', '"$1/2"', "grammar"), (r'\] "[^\n]*', '] "CUT', "grammar"), (r"^[^\n]+", "", "grammar"),
)

COMMANDS = (
    ("get", ["readonly", "fast"], ["@read", "@string", "@fast"]), ("set", ["write", "denyoom"], ["@write", "@string", "@slow"]),
    ("incr", ["write", "denyoom", "fast"], ["@write", "@string", "@fast"]), ("hset", ["write", "denyoom", "fast"], ["@write", "@hash", "@fast"]),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = _table(spark, sf_dir, "events")
    cores = spark.sparkContext.defaultParallelism
    if len(events.inputFiles()) * 2 <= cores:  # few files: rows are narrow here and dear to parse
        events = events.repartition(cores)
    events = events.selectExpr("event_id", "unix_micros(cast(ts as timestamp)) as us", "user_id", "event_type", "props")
    return events.selectExpr("event_id", f"{_LINE} as value")


def feed_lines(spark: SparkSession, sf_dir: str, server=None, name: str | None = None, source_id: str = "stdin") -> DataFrame:
    return as_lines(_values(spark, sf_dir), source_id=source_id, seq=F.col("event_id"), server=server, name=name)


def _feed(spark: SparkSession, sf_dir: str, **source) -> Feed:
    return Feed(feed_lines(spark, sf_dir, **source), metadata.from_rows(spark, list(COMMANDS)))


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with a line in 17 spoiled in each way, and replies that are skipped."""
    value = F.col("value")
    for i, (pattern, new, _) in enumerate(SPOILED):
        value = F.when(F.col("event_id") % 17 == i, F.regexp_replace("value", pattern, new)).otherwise(value)
    value = F.when(F.expr("event_id % 17 = 16"), F.lit("OK")).otherwise(value)
    return as_lines(_values(spark, sf_dir).withColumn("value", value), seq=F.col("event_id"))


def _tcp(spark: SparkSession, sf_dir: str, host: str, ip: str | None = None) -> DataFrame:
    return feed_lines(spark, sf_dir, server=server_literal("tcp", host, 6379, None, ip), name="main", source_id=f"{host}:6379")


def _text(rendered: DataFrame) -> DataFrame:
    return rendered.select(F.col("seq").alias("event_id"), F.col("value").cast("string").alias("value"))


# ---------------------------------------------------------------- the feeds, in SQL

_FEED = """
with recursive e as (select event_id, epoch_us(ts) as us, user_id, user_id % 16 as db, props, event_id % 5 as k,
    case event_type when 'view' then 'GET' when 'click' then 'INCR' when 'purchase' then 'SET' when 'signup' then 'HSET' else 'EVALSHA' end as cmd from events),
  c as (select *, cast(us // 1000000 as varchar) as sec, lpad(cast(us % 1000000 as varchar), 6, '0') as frac,
    case k when 0 then 'tcp' when 1 then 'tcp' when 2 then 'path' when 3 then 'lua' else 'unknown' end as kind,
    case k when 0 then '127.0.0.1' when 1 then '2001:db8::' || case when user_id % 10 = 0 then '' else cast(user_id % 10 as varchar) end end as host,
    case k when 0 then 49152 + user_id when 1 then 40000 + user_id end as port, case when k = 2 then '/run/app/u' || user_id || '.sock' end as path,
    case k when 0 then '127.0.0.1:' || (49152 + user_id) when 1 then '[2001:db8::' || (user_id % 10) || ']:' || (40000 + user_id) when 2 then 'unix:/run/app/u' || user_id || '.sock' when 3 then 'lua' else '' end as shown from e),
  f as (select *, rtrim(rtrim(sec || '.' || frac, '0'), '.') as t, coalesce(host || ':' || port, path, case when kind = 'lua' then 'lua' else '-' end) as addr, '"user:' || user_id || '" "' || props || '"' as tail,
    sec || '.' || frac || ' [' || db || ' ' || shown || '] "' || cmd || '" "user:' || user_id || '" "' || props || '"' as line from c)
"""


def _sql(body: str) -> str:
    return f"{_FEED} {body}"


_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def add(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


# ---------------------------------------------------------------- counts


@_query(_sql("select cmd as name, count(*) as count, sum(octet_length(encode(line)))::bigint as bytes from f group by 1"))
def command_stats(spark, sf_dir):
    return _feed(spark, sf_dir).stats()


@_query(_sql("select cmd as name, count(*) - 1 as count, (sum(octet_length(encode(line))) - arg_min(octet_length(encode(line)), event_id))::bigint as bytes from f group by 1"))
def command_stats_compat(spark, sf_dir):
    return _feed(spark, sf_dir).stats(exact=False)


@_query(_sql("select cmd as name, count(*) - 1 as count, (sum(octet_length(encode(line))) - arg_min(octet_length(encode(line)), event_id))::bigint as bytes from f group by 1 having count(*) > 1"))
def stats_nonzero(spark, sf_dir):
    return stats.nonzero(stats.by_command(feed_lines(spark, sf_dir), compat=True))


@_query(_sql("select '[stats]: ' || string_agg(cmd || '=[' || n || ', ' || b || ']', ', ' order by cmd) as value from (select cmd, count(*) as n, sum(octet_length(encode(line)))::bigint as b from f group by 1)"))
def stats_text(spark, sf_dir):
    return stats.as_text(_feed(spark, sf_dir).stats())


@_query(_sql("""select '[' || string_agg('{"name":"' || cmd || '","count":' || n || ',"bytes":' || b || '}', ',' order by cmd) || ']' as value from (select cmd, count(*) as n, sum(octet_length(encode(line)))::bigint as b from f group by 1)"""))
def stats_json(spark, sf_dir):
    return stats.as_json(_feed(spark, sf_dir).stats())


@_query(_sql("""select 'a:' || count(*) || ':{' || string_agg('i:' || i || ';a:3:{s:4:"name";s:' || length(cmd) || ':"' || cmd || '";s:5:"count";i:' || n || ';s:5:"bytes";i:' || b || ';}', '' order by cmd) || '}' as value
  from (select cmd, count(*) as n, sum(octet_length(encode(line)))::bigint as b, row_number() over (order by cmd) - 1 as i from f group by 1)"""))
def stats_php(spark, sf_dir):
    return stats.as_php(_feed(spark, sf_dir).stats())


@_query(_sql("select count(*) as total, count(*) filter (where not contains(lower(cmd), 'set')) as filtered from f"))
def io_counters(spark, sf_dir):
    return stats.counters(feed_lines(spark, sf_dir), LineFilter.of(["set"]).column())


# ---------------------------------------------------------------- parsing


@_query(_sql("select event_id, sec || '.' || frac as time_text, cast(sec || '.' || frac as double) as timestamp, us as event_us, db::bigint as db, kind, host, port::int as port, path, addr, cmd, 'user:' || user_id as arg1, props as arg2 from f"))
def parse_typed(spark, sf_dir):
    p = parse(feed_lines(spark, sf_dir))
    a = lambda i: L.lossy(F.get("args", F.lit(i)))
    return p.select(F.col("seq").alias("event_id"), F.concat("ts_int", F.lit("."), "ts_frac").alias("time_text"), "timestamp", F.unix_micros("event_time").alias("event_us"), F.col("db").cast("long").alias("db"), F.col("client.kind").alias("kind"), F.col("client.host").alias("host"), F.col("client.port").alias("port"), F.col("client.path").alias("path"), "addr", "cmd", a(0).alias("arg1"), a(1).alias("arg2"))


@_query(_sql(f"select count(*) filter (event_id % 17 not in ({', '.join(str(i) for i in range(len(SPOILED)))}, 16)) as ok, count(*) filter (event_id % 17 < {len(SPOILED)}) as rejected, count(*) filter (event_id % 17 < {len(SPOILED)}) as rejected_structured from f"))
def parse_reject_counts(spark, sf_dir):
    p = parse(without_replies(_spoiled(spark, sf_dir)))
    return p.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("rejected"), F.count_if(~F.col("args_ok")).alias("rejected_structured"))


@_query(_sql("select event_id, case event_id % 17 " + " ".join(f"when {i} then '{e}'" for i, (_, _, e) in enumerate(SPOILED)) + f" end as error from f where event_id % 17 < {len(SPOILED)}"))
def parse_rejects(spark, sf_dir):
    return rejected(parse(without_replies(_spoiled(spark, sf_dir)))).select(F.col("seq").alias("event_id"), "error")


@_query(_sql("select kind, count(*) as n from f group by 1"))
def client_kind_counts(spark, sf_dir):
    return parse(feed_lines(spark, sf_dir)).groupBy(F.col("client.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_query(_sql("select event_id, addr as ca, coalesce(host, '-') as ch, coalesce(port::varchar, case when kind = 'path' then 'u' || user_id || '.sock' when kind = 'lua' then 'lua' else '-' end) as cp from f"))
def client_parts(spark, sf_dir):
    p = parse(feed_lines(spark, sf_dir))
    return p.select(F.col("seq").alias("event_id"), *[formats.token(t).cast("string").alias(t) for t in ("ca", "ch", "cp")])


_IP_TEXT = """case event_id % 7 when 0 then concat('2001:0DB8:0:00:000:0:0:', lpad(upper({hex}), 4, '0')) when 1 then concat('A:0b:C:0:e:F:1:', {hex}) when 2 then concat('::ffff:10.1.', {n} % 256, '.', {n} % 100)
  when 3 then concat('172.16.', {n} % 256, '.', {n} % 300) when 4 then concat('12345::', {hex}) when 5 then concat('1:0:0:2:0:0:0:', {hex}) else concat('0:0:3:4:0:0:7:', {hex}) end"""


@_query(f"""with e as (select event_id, user_id + 1 as n, to_hex(user_id + 1) as h from events)
  select event_id, {_IP_TEXT.format(hex="lower(h)", n="n")} as text, case event_id % 7 when 0 then '2001:db8::' || lower(h) when 1 then 'a:b:c:0:e:f:1:' || lower(h) when 2 then '::ffff:10.1.' || (n % 256) || '.' || (n % 100)
    when 3 then case when n % 300 < 256 then '172.16.' || (n % 256) || '.' || (n % 300) end when 5 then '1:0:0:2::' || lower(h) when 6 then '::3:4:0:0:7:' || lower(h) end as ip from e""")
def ip_canonical(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(_IP_TEXT.format(hex="lower(hex(user_id + 1))", n="(user_id + 1)")).alias("text"))
    return addresses.with_canonical_ip(rows, F.col("text"), "ip")


# ---------------------------------------------------------------- filters


def _filtered(test: str) -> str:
    return _sql(f"select event_id, line from f where {test}")


def _passing(spark, sf_dir, patterns=(), flags=(), db=None) -> DataFrame:
    return _feed(spark, sf_dir).filter(list(patterns), list(flags), db).lines.select(F.col("seq").alias("event_id"), F.col("line").cast("string").alias("line"))


@_query(_filtered("contains(lower(cmd), 'set')"))
def filter_include(spark, sf_dir):
    return _passing(spark, sf_dir, ["set"])


@_query(_filtered("not contains(lower(cmd), 'get') and not contains(lower(cmd), 'incr')"))
def filter_exclude(spark, sf_dir):
    return _passing(spark, sf_dir, ["!GET", "!incr"])


@_query(_filtered("(contains(lower(cmd), 'set') or regexp_matches(cmd, '^EVAL')) and not regexp_matches(cmd, '^H')"))
def filter_mixed(spark, sf_dir):
    return _passing(spark, sf_dir, ["set", "/^EVAL/", "!/^H/"])


@_query(_filtered("regexp_matches(cmd, '^(GET|INCR)$')"))
def filter_regex(spark, sf_dir):
    return _passing(spark, sf_dir, ["/^(GET|INCR)$/"])


@_query(_filtered("regexp_matches(cmd, '^(get|SET)$')"))
def filter_regex_case(spark, sf_dir):
    return _passing(spark, sf_dir, ["/^(get|SET)$/"])


@_query(_filtered("cmd in ('HSET', 'SET', 'EVALSHA')"))
def filter_many_literals(spark, sf_dir):
    """Ten thousand literals, of which a few occur."""
    return _passing(spark, sf_dir, [f"x{i}.{i % 97}" for i in range(10_000)] + ["hse", "alsh", "set"])


@_query(_sql("select line from f where contains(lower(cmd), 'set') union all (values ('PONG'), ('OK'), (''), ('one \" quote'))"))
def filter_no_command_passes(spark, sf_dir):
    more = spark.createDataFrame([(-1, "PONG"), (-2, "OK"), (-3, ""), (-4, 'one " quote')], "event_id long, value string")
    lines = as_lines(_values(spark, sf_dir).unionByName(more), seq=F.col("event_id"))
    return Feed(lines).filter(["set"]).lines.select(F.col("line").cast("string").alias("line"))


@_query(_filtered("cmd in ('SET', 'INCR', 'HSET', 'EVALSHA')"))
def filter_flags_write(spark, sf_dir):
    return _passing(spark, sf_dir, flags=["wo"])


@_query(_filtered("cmd in ('HSET', 'EVALSHA')"))
def filter_flags_all(spark, sf_dir):
    return _passing(spark, sf_dir, flags=["write,@hash"])


@_query(_filtered("cmd in ('GET', 'SET', 'INCR', 'EVALSHA')"))
def filter_category(spark, sf_dir):
    return _passing(spark, sf_dir, flags=[" @STRING "])


@_query(_filtered("cmd = 'EVALSHA'"))
def filter_flags_unknown_passes(spark, sf_dir):
    return _passing(spark, sf_dir, flags=["admin"])


@_query(_filtered("true"))
def filter_bad_flag_is_noop(spark, sf_dir):
    return _passing(spark, sf_dir, flags=["nosuch"])


@_query(_filtered("db = 3"))
def filter_db(spark, sf_dir):
    return _passing(spark, sf_dir, db=3)


# ---------------------------------------------------------------- metadata

#: The flags of an event: bit i of this number tells of the i-th one.
_MASK = "((event_id * 31 + user_id) % 1048576)"


def _flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's flag names, some in upper case with blanks, and one that is unknown."""
    bit = lambda i: F.expr(f"shiftright({_MASK}, {i}) % 2 = 1")
    names = F.array_compact(F.array(F.lit("nosuch"), *[F.when(bit(i), F.lit(f" {n.upper()} " if i % 2 else n)) for i, n in enumerate(bits.FLAGS)]))
    return _table(spark, sf_dir, "events").select("event_id", names.alias("f"))


@_query(f"select event_id, {_MASK}::int as mask from events")
def flag_mask_fold(spark, sf_dir):
    return _flag_names(spark, sf_dir).select("event_id", bits.fold(F.col("f"), bits.FLAG_BITS).alias("mask"))


@_query(f"select event_id, coalesce(string_agg(name, ',' order by name), '') as names from events left join (values {', '.join(f"('{n}', {b.bit_length() - 1})" for n, b in bits.FLAG_BITS.items())}) t(name, i) on ({_MASK} >> i) % 2 = 1 group by 1")
def flag_mask_names(spark, sf_dir):
    return flag_mask_fold(spark, sf_dir).select("event_id", F.array_join(bits.names_of(F.col("mask"), bits.FLAG_BITS), ",").alias("names"))


_REPLY = """concat('["Cmd', p_partkey, '",', p_size - 20, ',[', case when p_size % 2 = 0 then '"readonly","fast"' else '"Write"' end, '],', p_size % 3, ',1,1,["@read","@nosuch"],[]',
  case p_partkey % 4 when 0 then concat(',[["flags",["RO","access"],"begin_search",["type","index","spec",["index",', p_size, ']],"find_keys",["type","range","spec",["lastkey",-1,"keystep",1,"limit",0]]]]')
    when 1 then concat(',[["flags",["RW"],"begin_search",["type","keyword","spec",["keyword","K', p_size, '","startfrom",2]],"find_keys",["type","keynum","spec",["keynumidx",0,"firstkey",1,"keystep",1]]]]') else '' end, ']')"""


@_query("""select 'Cmd' || p_partkey as name, (p_size - 20)::bigint as arity, case when p_size % 2 = 0 then 32800 else 524288 end as flags, 4096 as categories, (p_size % 3)::bigint as first_key,
    case p_partkey % 4 when 0 then 18 when 1 then 1 end as spec_flags, case p_partkey % 4 when 0 then 'index' when 1 then 'keyword' end as begin_kind, case when p_partkey % 4 = 0 then p_size::bigint end as begin_index,
    case when p_partkey % 4 = 1 then 'K' || p_size end as keyword, case p_partkey % 4 when 0 then 'range' when 1 then 'keynum' end as find_kind, case when p_partkey % 4 = 0 then -1::bigint end as last_key from part where p_partkey % 9 <> 7""")
def command_table(spark, sf_dir):
    """Replies of a command for each part; one in nine is too short and goes."""
    replies = _table(spark, sf_dir, "part").select(F.expr(f"case when p_partkey % 9 = 7 then concat('[\"Cmd', p_partkey, '\",1,[],0,0]') else {_REPLY} end").alias("reply"))
    s = F.get("key_specs", F.lit(0))
    return metadata.commands(replies).select("name", "arity", "flags", "categories", "first_key", s["flags"].alias("spec_flags"), s["begin_search"]["kind"].alias("begin_kind"), s["begin_search"]["index"].alias("begin_index"), s["begin_search"]["keyword"].alias("keyword"), s["find_keys"]["kind"].alias("find_kind"), s["find_keys"]["last_key"].alias("last_key"))


# ---------------------------------------------------------------- formats


@_query(_sql("""select event_id, t || ' [' || db || ' ' || addr || '] "' || cmd || '" ' || tail as value from f"""))
def fmt_default_single(spark, sf_dir):
    return _text(_feed(spark, sf_dir).render())


@_query(_sql("""select event_id, h || ':' || event_id as id, t || ' [' || h || ':6379 ' || addr || ' ' || db || '] "' || cmd || '" ' || tail as value from f cross join (values ('one.test'), ('two.test')) s(h)"""))
def fmt_default_multi(spark, sf_dir):
    feed = Feed(_tcp(spark, sf_dir, "one.test")).union(Feed(_tcp(spark, sf_dir, "two.test")))
    return feed.render().select(F.col("seq").alias("event_id"), F.concat("server.host", F.lit(":"), F.col("seq").cast("string")).alias("id"), F.col("value").cast("string").alias("value"))


@_query(_sql("""select event_id, 'h.test:6379|h.test|6379|main|' || addr || '|' || coalesce(host, '-') || '|' || coalesce(port::varchar, case when kind = 'path' then 'u' || user_id || '.sock' when kind = 'lua' then 'lua' else '-' end) || '|' || t || '|' || db || '|' || cmd || '|' || tail || '|"' || cmd || '" ' || tail as value from f"""))
def fmt_tokens(spark, sf_dir):
    return _text(serializers.render(parse(_tcp(spark, sf_dir, "h.test")), "plain", "%sa|%sh|%sp|%sn|%ca|%ch|%cp|%t|%d|%C|%a|%l"))


@_query(_sql("select event_id, case when host = '127.0.0.1' then '6379 ' || port else 'local.test:6379 ' || addr end as value from f"))
def fmt_short_addr(spark, sf_dir):
    return _text(serializers.render(parse(_tcp(spark, sf_dir, "local.test", "127.0.0.1")), "plain", "%S"))


@_query(_sql("select event_id, '%%|%' || db || '|%x|%sx|stdin|-|%' as value from f"))
def fmt_percent_quirk(spark, sf_dir):
    return _text(serializers.render(parse(feed_lines(spark, sf_dir)), "plain", "%%|%%d|%x|%sx|%sp|%sn|%"))


#: A number's digits before and after the point: six after it in two of three orders, else fewer, which a double holds.
_SECONDS, _FRACTION = "lpad({n}, case when o_orderkey % 2 = 0 then 9 else cast(length({n}) as int) end, '0')", "case o_orderkey % 3 when 0 then '250000' when 1 then lpad({c}, 6, '0') else rpad({c}, 4, '0') end"


@_query(f"""with o as (select o_orderkey, cast(o_orderkey * 7 as varchar) as n, cast(o_custkey as varchar) as c from orders), t as (select o_orderkey, n, {_SECONDS.format(n="n")} as s, {_FRACTION.format(c="c")} as f from o)
  select o_orderkey, s || '.' || f as text, case when rtrim(f, '0') = '' then n else n || '.' || rtrim(f, '0') end as value from t""")
def fmt_timestamp_canonical(spark, sf_dir):
    n, c = "cast(o_orderkey * 7 as string)", "cast(o_custkey as string)"
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"concat({_SECONDS.format(n=n)}, '.', {_FRACTION.format(c=c)}, ' [0 lua] \"PING\"')").alias("value"))
    p = serializers.render(parse(as_lines(rows, seq=F.col("o_orderkey"))), "plain", "%t")
    return p.select(F.col("seq").alias("o_orderkey"), F.concat("ts_int", F.lit("."), "ts_frac").alias("text"), F.col("value").cast("string").alias("value"))


# ---------------------------------------------------------------- event time


@_query(_sql("select epoch_us(time_bucket(interval '10 minutes', make_timestamp(us))) as start_us, cmd, count(*) as count, sum(octet_length(encode(line)))::bigint as bytes from f group by 1, 2"))
def event_windows(spark, sf_dir):
    return windows.by_window(feed_lines(spark, sf_dir)).select(F.unix_micros("start").alias("start_us"), "cmd", "count", "bytes")


@_query(_sql("""select addr, min(us) as start_us, max(us) + 300000000 as end_us, count(*) as count from (
    select addr, us, sum(new) over (partition by addr order by us, event_id) as s from (select addr, us, event_id, case when us <= lag(us) over (partition by addr order by us, event_id) + 300000000 then 0 else 1 end as new from f)) group by addr, s"""))
def client_sessions(spark, sf_dir):
    return windows.sessions(feed_lines(spark, sf_dir)).select("addr", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "count")


@_query(_sql("select cmd, count(*) as n from (select distinct line, cmd from f) group by 1"))
def lines_once_each(spark, sf_dir):
    """The feed read twice."""
    lines = windows.once_each(Feed(feed_lines(spark, sf_dir)).union(Feed(feed_lines(spark, sf_dir))).lines)
    return lines.groupBy(L.command(F.col("line")).alias("cmd")).agg(F.count(F.lit(1)).alias("n"))


@_query(_sql("select cmd, count(*) as lines, count(distinct user_id) as keys, true as keys_near, true as median_near from f group by 1"))
def sketches_near_exact(spark, sf_dir):
    """Sketches of each day, merged by command, against the exact figures: distinct keys within 3 percent, the median size within 2 percent of rank."""
    lines = feed_lines(spark, sf_dir)
    near = sketches.estimates(sketches.merged(sketches.daily(lines), "cmd"), 0.5)
    sizes = F.octet_length("line").cast("long")
    exact = parse(lines).select(F.col("cmd").alias("_cmd"), F.get("args", F.lit(0)).alias("key"), sizes.alias("size"))
    exact = exact.groupBy("_cmd").agg(F.countDistinct("key").alias("keys"), F.percentile("size", F.lit(0.48)).alias("low"), F.percentile("size", F.lit(0.52)).alias("high"))
    both = near.join(exact, F.col("cmd") == F.col("_cmd"))
    return both.select("cmd", "lines", "keys", (F.abs(F.col("distinct_keys") - F.col("keys")) <= 0.03 * F.col("keys") + 1).alias("keys_near"), F.col("size_50").between(F.floor("low"), F.ceil("high")).alias("median_near"))


# ---------------------------------------------------------------- arguments


def _escaped(text: str):
    out = F.coalesce(F.col(text), F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _round_trip(table: DataFrame, key: str, text: str) -> DataFrame:
    value = F.concat(F.lit('1650000000.125000 [0 lua] "SET" "k" "'), _escaped(text), F.lit('"'))
    p = parse(as_lines(table.select(F.col(key).alias("id"), value.alias("value")), seq=F.col("id")))
    return accepted(p, structured=True).select(F.col("seq").alias(key), F.size("args").alias("n"), L.to_bytes(F.get("args", F.lit(1))).cast("string").alias(text))


@_query("select page_id, 2 as n, coalesce(html, '') as html from pages")
def args_roundtrip_pages(spark, sf_dir):
    return _round_trip(_table(spark, sf_dir, "pages"), "page_id", "html")


@_query("select doc_id, 2 as n, coalesce(text, '') as text from documents")
def args_roundtrip_documents(spark, sf_dir):
    return _round_trip(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query(_sql("select cmd, 2 as n_args, count(*) as n from f group by 1"))
def args_count(spark, sf_dir):
    p = accepted(parse(feed_lines(spark, sf_dir)), structured=True)
    return p.groupBy("cmd", F.size("args").alias("n_args")).agg(F.count(F.lit(1)).alias("n"))


@_query(_sql("select event_id, 0 as place, 'user:' || user_id as arg from f union all select event_id, 1, props from f"))
def args_explode(spark, sf_dir):
    p = accepted(parse(feed_lines(spark, sf_dir)), structured=True)
    return p.select(F.col("seq").alias("event_id"), F.posexplode("args").alias("place", "arg")).select("event_id", "place", L.lossy(F.col("arg")).alias("arg"))


# ---------------------------------------------------------------- serializers

_T1 = "case when contains(t, '.') then t else t || '.0' end"
_JSON_ARG = "replace(replace(props, '\\', '\\\\'), '\"', '\\\"')"


@_query(_sql(f"""select event_id, '{{"timestamp":' || {_T1} || ',"db":' || db || ',"addr":"' || addr || '","cmd":"' || cmd || '","args":["user:' || user_id || '","' || {_JSON_ARG} || '"]}}' as value from f"""))
def out_json(spark, sf_dir):
    return _text(_feed(spark, sf_dir).render("json"))


@_query(_sql(f"""select event_id, {_T1} || ',' || db || ',' || addr || ',' || cmd || ',user:' || user_id || ',"' || replace(props, '"', '""') || '"' as value from f"""))
def out_csv(spark, sf_dir):
    return _text(_feed(spark, sf_dir).render("csv"))


@_query(_sql("""select event_id, '*3' || x || '$' || length(cmd) || x || cmd || x || '$' || length('user:' || user_id) || x || 'user:' || user_id || x || '$' || length(props) || x || props || x as value from f cross join (select chr(13) || chr(10) as x)"""))
def out_resp(spark, sf_dir):
    return _text(_feed(spark, sf_dir).render("resp"))


@_query(_sql("""select event_id, 'a:5:{s:9:"timestamp";d:' || t || ';s:2:"db";i:' || db || ';s:4:"addr";s:' || length(addr) || ':"' || addr || '";s:3:"cmd";s:' || length(cmd) || ':"' || cmd || '";s:4:"args";a:2:{i:0;s:' || length('user:' || user_id) || ':"user:' || user_id || '";i:1;s:' || length(props) || ':"' || props || '";}}' as value from f"""))
def out_php(spark, sf_dir):
    return _text(_feed(spark, sf_dir).render("php"))


# ---------------------------------------------------------------- sources

_SERVER_TEXT = """case c_custkey % 8 when 0 then cast(1000 + c_custkey % 60000 as {t}) when 1 then concat('kv', c_custkey, ':', 7000 + c_custkey % 100) when 2 then concat('kv', c_custkey) when 3 then cast(65530 + c_custkey as {t})
  when 4 then concat('a', c_custkey, ':b:c') when 5 then concat('kv', c_custkey, ':', 65530 + c_custkey % 12) when 6 then concat('/tmp/kv', c_custkey, '.sock') else concat('kv', c_custkey, ':') end"""


@_query(f"""select c_custkey, {_SERVER_TEXT.format(t="varchar")} as text, case c_custkey % 8 when 0 then 'tcp 127.0.0.1:' || (1000 + c_custkey % 60000) when 1 then 'tcp kv' || c_custkey || ':' || (7000 + c_custkey % 100) when 2 then 'tcp kv' || c_custkey || ':6379'
  when 3 then case when c_custkey <= 5 then 'tcp 127.0.0.1:' || (65530 + c_custkey) else 'tcp ' || (65530 + c_custkey) || ':6379' end when 4 then 'tcp a' || c_custkey || ':6379'
  when 5 then case when c_custkey % 12 <= 5 then 'tcp kv' || c_custkey || ':' || (65530 + c_custkey % 12) else 'error' end when 6 then 'unix /tmp/kv' || c_custkey || '.sock' else 'error' end as shown from customer""")
def server_addr_parse(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_SERVER_TEXT.format(t="string")).alias("text")).withColumn("a", addresses.server_address(F.col("text")))
    return rows.select("c_custkey", "text", F.when(F.col("a.kind") == "error", "error").otherwise(F.concat("a.kind", F.lit(" "), addresses.server_text(F.col("a")))).alias("shown"))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot range for each supplier, its nation the primary; up to two replicas, here and there a broken node or no node at all."""
    node = lambda host, port, name: f"named_struct('host', {host}, 'port', {port}, 'id', {name})"
    replica = lambda k: node(f"concat('10.1.', s_nationkey, '.{k}')", 7001, f"concat('r', s_nationkey, '-{k}')")
    own, none = node("concat('10.0.0.', s_nationkey)", 7000, "concat('n', s_nationkey)"), node("cast(null as string)", 7001, "'x'")
    nodes = f"case when s_suppkey % 11 = 5 then array() else array_compact(array({own}, case when s_suppkey % 3 > 0 then {replica(1)} end, case when s_suppkey % 7 = 0 then {none} end, case when s_suppkey % 3 > 1 then {replica(2)} end)) end"
    return _table(spark, sf_dir, "supplier").selectExpr("s_suppkey * 16 as start", "s_suppkey * 16 + 15 as end", f"{nodes} as nodes")


_PRIMARIES = "select s_nationkey as k, arg_min(s_suppkey % 3, s_suppkey) as n from supplier where s_suppkey % 11 <> 5 group by 1"


@_query(f"select '10.0.0.' || k as host, 7000 as port, 'n' || k as id, n::int as n_replicas from ({_PRIMARIES})")
def cluster_nodes_distinct(spark, sf_dir):
    return topology.nodes(_slots(spark, sf_dir)).select("host", "port", "id", F.size("replicas").alias("n_replicas"))


@_query(f"select 'n' || k as id, '10.0.0.' || k as host, 7000 as port, 'primary' as role from ({_PRIMARIES}) union all select 'r' || k || '-' || i, '10.1.' || k || '.' || i, 7001, 'replica' from (select k, unnest(range(1, n + 1)) as i from ({_PRIMARIES}))")
def cluster_expand_replicas(spark, sf_dir):
    return topology.members(topology.nodes(_slots(spark, sf_dir)), replicas=True)


@_query("""select n_name as name, case when n_nationkey % 3 = 0 then 'tcp 10.2.0.' || n_nationkey || ':' || (6400 + n_nationkey) else 'unix /tmp/n' || n_nationkey || '.sock' end as shown from nation where n_nationkey % 3 <> 1
  union all select n_name, 'tcp ' || h || n_nationkey || p from nation cross join (values ('p', ':7000'), ('q', ':6379')) t(h, p) where n_nationkey % 3 = 1 union all select distinct null, 'tcp 127.0.0.1:' || (7000 + c_custkey % 50) from customer""")
def config_sources(spark, sf_dir):
    """Entries named after nations, and ports that customers name, many of them alike."""
    entry = lambda i, value, kind: f"case when n_nationkey % 3 = {i} then {value} end as {kind}"
    nation = _table(spark, sf_dir, "nation")
    entries = nation.selectExpr("n_name as name", entry(0, "concat('10.2.0.', n_nationkey)", "host"), entry(0, "6400 + n_nationkey", "port"), entry(1, "array(concat('p', n_nationkey, ':7000'), concat('q', n_nationkey))", "addresses"), "case when n_nationkey % 3 <> 1 then concat('/tmp/n', n_nationkey, '.sock') end as path", "cast(null as string) as user", "cast(null as string) as pass")
    instances = nation.select(F.col("n_name").alias("instance")).unionAll(_table(spark, sf_dir, "customer").select(F.expr("cast(7000 + c_custkey % 50 as string)")))
    return topology.resolve(instances, entries).select("name", F.concat("address.kind", F.lit(" "), addresses.server_text(F.col("address"))).alias("shown"))


@_query(_sql("select source_id, cmd, count(*) as n from f cross join (values ('one.test:6379'), ('two.test:6379')) s(source_id) group by 1, 2"))
def union_sources(spark, sf_dir):
    feed = Feed(_tcp(spark, sf_dir, "one.test")).union(Feed(_tcp(spark, sf_dir, "two.test")))
    return feed.lines.groupBy("source_id", L.command(F.col("line")).alias("cmd")).agg(F.count(F.lit(1)).alias("n"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The feed as text files, in the folder that the cluster's machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="feedlens-")
    path = f"{base.rstrip('/')}/feed-{uuid.uuid4().hex}"
    _values(spark, sf_dir).select(F.concat(F.lit("+"), "value").alias("value")).write.text(path)
    return path


@_query(_sql("select line from f"))
def replay_text(spark, sf_dir):
    return read_lines(spark, _written(spark, sf_dir)).select(F.col("line").cast("string").alias("line"))


@_query(_sql("select cmd as name, count(*) as count, sum(octet_length(encode(line)))::bigint as bytes from f group by 1"))
def stream_stats_available_now(spark, sf_dir):
    path = _written(spark, sf_dir)
    out = f"{path}-out"
    query = stats_query(stream_lines(spark, path), lambda batch, n: batch.write.mode("overwrite").parquet(out), f"{path}-checkpoint")
    query.awaitTermination()
    return spark.read.parquet(out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
