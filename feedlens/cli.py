"""Command line: replay files through the engine, or follow live feeds."""

from __future__ import annotations

import argparse
import dataclasses
import itertools
import json
import shutil
import sys
import tempfile

from feedlens.plans import formats, serializers
from feedlens.plans.filters import LineFilter, Pattern
from feedlens.sources import config
from feedlens.streaming.feed import positive

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="feedlens", description="Analyse command feeds")
    p.add_argument("-c", "--cluster", action="store_true", help="take each instance as a seed of a cluster")
    p.add_argument("-f", "--format", help="format of plain output")
    p.add_argument("-r", "--replicas", action="store_true", help="read replicas of a cluster too")
    p.add_argument("--config-file")
    p.add_argument("--no-color", action="store_true", help="accepted; output has no colour")
    p.add_argument("--db", type=int, help="only lines of one database")
    p.add_argument("-u", "--user")
    p.add_argument("-p", "-a", "--pass", dest="password")
    p.add_argument("--filter", action="append", default=[], help="literal or /regex/ for command names, ! in front excludes")
    p.add_argument("--flags", action="append", default=[], help="required flags and @categories")
    p.add_argument("-o", "--output", default="plain", type=serializers.kind_of)
    p.add_argument("--tls", action="store_true")
    p.add_argument("--insecure", action="store_true")
    p.add_argument("--tls-ca")
    p.add_argument("--tls-cert")
    p.add_argument("--tls-key")
    p.add_argument("--stats", type=positive, help="seconds between counts")
    p.add_argument("--stdin", metavar="PATH", nargs="?", const="-", help="replay files instead of connecting")
    p.add_argument("--out", help="folder for the output, else it is printed")
    p.add_argument("--debug", action="store_true")
    p.add_argument("-v", "--version", action="version", version=f"feedlens {VERSION}")
    p.add_argument("instances", nargs="*")
    return p


def _spooled(spark) -> str:
    """Standard input as a file, copied block by block. Only a local session can read a file of this machine."""
    if not spark.sparkContext.master.startswith("local"):
        raise SystemExit("standard input is replayed by local sessions only; put the capture on shared storage and name its path")
    with tempfile.NamedTemporaryFile(prefix="feedlens-", suffix=".log", delete=False) as file:
        shutil.copyfileobj(sys.stdin.buffer, file, 1 << 20)
    return file.name


def main(argv: list[str] | None = None) -> int:
    options = parser().parse_args(argv)
    for x in options.filter:
        Pattern.parse(x)
    test = LineFilter.of(options.filter, options.flags, options.db)
    if options.debug:
        print(test, file=sys.stderr)
    from pyspark.sql import Observation, SparkSession

    from feedlens.engine import Feed
    from feedlens.operators import stats as S
    from feedlens.sources import sink

    spark = SparkSession.builder.appName("feedlens").getOrCreate()
    if options.stdin:
        feed = Feed.read(spark, _spooled(spark) if options.stdin == "-" else options.stdin)
        seen = Observation("io")
        kept = feed.filter(options.filter, options.flags, options.db, seen)
        if options.stats:
            print(*(r[0] for r in S.as_text(feed.filter(options.filter, options.flags, options.db).stats()).collect()), sep="\n", file=sys.stderr)
        if options.out:  # one pass writes records and dead letters and counts
            kept.save(options.out, options.output, options.format)
            counts = seen.get
        else:
            counts = S.counters(feed.lines, test.column(metadata=False)).first().asDict()
            shown = sink.outcome(feed.filter(options.filter, options.flags, options.db).parse(), options.output, options.format)
            for row in shown.select("value", "message").toLocalIterator():
                if row.value is None:
                    print(row.message, file=sys.stderr)
                else:
                    sys.stdout.buffer.write(bytes(row.value) + sink.ENDS[options.output])
            sys.stdout.flush()
        print(S.report(counts["total"], counts["filtered"]), file=sys.stderr)
        return 0
    from feedlens.operators import topology
    from feedlens.sources import live
    from feedlens.streaming import feed as streams
    from feedlens.streaming.counters import Totals

    tls = config.Tls(options.insecure, options.tls_ca, options.tls_cert, options.tls_key) if options.tls else None
    found = config.sources(options.instances, config.load(options.config_file), options.user, options.password, tls)
    login = lambda s: {"user": s.user, "password": s.password, "tls": {k: v for k, v in vars(s.tls).items() if v} if s.tls else None}
    seeds = [s for s in found if s.cluster or options.cluster]
    found = [s for s in found if s not in seeds]
    for _, group in itertools.groupby(seeds, key=lambda s: s.name or ""):  # the addresses of an entry are seeds of one cluster
        group = list(group)
        slots = spark.createDataFrame(live.slot_rows([s.address.text for s in group], **login(group[0])), "start long, end long, nodes array<struct<host string, port int, id string>>")
        found += [dataclasses.replace(group[0], address=config.Address("tcp", n["host"], n["port"]), name=n["id"]) for n in topology.members(topology.nodes(slots), options.replicas).collect()]  # servers of a cluster
    found = list(dict.fromkeys(found))
    print("MONITOR: " + ", ".join(s.address.text for s in found), file=sys.stderr)
    spark.dataSource.register(live.FeedSource)
    reader = spark.readStream.format("command_feed").option("addresses", ",".join(s.address.text for s in found)).option("names", ",".join(s.name or "" for s in found))
    if not options.out:
        raise SystemExit("a live feed needs --out: a folder for output, capture and checkpoints")
    capture = f"{options.out}/_capture"
    feed = Feed(reader.option("logins", json.dumps([login(s) for s in found])).option("capture", capture).option("metadata", str(test.needs_metadata)).load())
    wanted = options.filter, options.flags, options.db
    with Totals(spark) as totals:
        lines = feed.filter(*wanted, seen=totals.name).lines
        queries = [streams.render_query(lines, f"{options.out}/lines", f"{options.out}/_render", options.output, options.format or (formats.MULTI if len(found) > 1 else formats.SINGLE), once=False)]
        if options.stats:  # over what the first query captures: one connection a source
            again = dataclasses.replace(feed, lines=live.follow(spark, capture, test.needs_metadata)).filter(*wanted).lines
            queries.append(streams.stats_query(again, lambda b, n: print(*(r[0] for r in S.as_text(b).collect()), sep="\n", file=sys.stderr), f"{options.out}/_stats", options.stats))
        try:
            queries[0].awaitTermination()
        except KeyboardInterrupt:
            for q in queries:
                q.stop()
        finally:
            print(totals.report(queries[0].id, live.stalls(spark, capture)), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
