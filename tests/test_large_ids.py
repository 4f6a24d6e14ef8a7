"""User ids that no TCP port and no hextet holds: such lines are rejected, and all others are as in SQL."""

import ipaddress

import duckdb
import pytest
from pyspark.sql import functions as F

from feedlens import queries as feed
from feedlens.operators.parse import parse
from oracle import connect, rows

#: Ports are 49152 and 40000 above the user id, of one event in five each.
VALID = "not (event_id % 5 = 0 and user_id > 65535 - 49152) and not (event_id % 5 = 1 and user_id > 65535 - 40000)"
NAMED = "args_count args_explode client_kind_counts client_parts client_sessions event_windows fmt_default_multi fmt_default_single fmt_percent_quirk fmt_short_addr fmt_tokens lines_once_each out_csv out_json out_php out_resp parse_typed".split()
#: Queries that keep a row for a rejected line, and the column that is null in it.
KEPT = {"client_kind_counts": "kind", "client_parts": "ca", "parse_typed": "cmd"}


@pytest.fixture(scope="module")
def folders(sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("ids")
    for name, where in (("all", "true"), ("valid", VALID)):
        (out / name).mkdir()
        duckdb.sql(f"copy (select * from (select * replace (user_id + event_id % 8 * 13000 as user_id) from '{sf_dir}/events.parquet') where {where}) to '{out / name}/events.parquet' (format parquet)")
    return str(out / "all"), str(out / "valid")


@pytest.mark.parametrize("name", NAMED)
def test_valid_lines_are_as_in_sql(spark, folders, name):
    got = feed.queries()[name](spark, folders[0])
    if name in KEPT:
        got = got.where(F.col(KEPT[name]).isNotNull())
    assert rows(got.toPandas().astype(object)) == rows(connect(folders[1]).sql(feed.oracle_sql()[name]).df().astype(object))


def test_the_other_lines_are_rejected(spark, folders):
    found = parse(feed.feed_lines(spark, folders[0])).groupBy("error").count().collect()
    count = lambda i: connect(folders[i]).sql("select count(*) from events").fetchall()[0][0]
    assert {r.error: r["count"] for r in found} == {None: count(1), "client address": count(0) - count(1)}
    assert count(0) > count(1) > 0


def test_canonical_ip_of_wide_hextets(spark, folders):
    """A third witness: the standard library."""
    def canonical(text):
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None

    found = feed.queries()["ip_canonical"](spark, folders[0]).collect()
    assert any(r.event_id % 7 == 1 and len(r.text.split(":")[-1]) > 4 for r in found)
    assert [r.ip for r in found] == [canonical(r.text) for r in found]
