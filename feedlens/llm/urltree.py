"""URL filter: explicit host and path rules, then a tree of path templates, in DataFrame functions only.

Per host the path segments form a tree. From the root down, segments that few pages share become the wildcard `*`
where a fork has many of them; its frequent segments keep their names. Sibling templates whose labelled shares
of bad pages do not differ beyond chance are merged. A template is rejected where its branch's share of bad
labels, smoothed towards the share of all siblings and that towards the host's, is high.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import LOWER, UPPER, saved


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules of the production query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


@dataclass(frozen=True)
class Params:
    min_children: int = 8  #: rare children from which a fork has a wildcard
    few_pages: int = 2  #: pages of a rare child at most
    z: float = 1.64  #: siblings whose shares differ by fewer standard errors than this are merged
    bins: int = 50  #: siblings whose shares lie within 1/bins are taken together before the test
    prior: float = 4.0  #: labelled pages that each smoothing counts for: branch to siblings, siblings to host, host to prior_bad
    prior_bad: float = 0.25
    reject: float = 0.5  #: smoothed bad share from which a template is rejected


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without a ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits, else null. Of equally long ones that with the longer host."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.action))
    text, action = [F.when(_fits(r, host, path), r.text) for r in ranked], [F.when(_fits(r, host, path), r.action) for r in ranked]
    none = F.lit(None).cast("string")
    return F.coalesce(*text, none), F.coalesce(*action, none)


#: Of each segment that is left: the hashes of those before it, and the segment.
_STEPS = """
aggregate(slice(parts, at + 1, size(parts)), named_struct('a', 1L, 'b', 2L, 'out', cast(array() as array<struct<a: bigint, b: bigint, part: string>>)),
  (s, x) -> named_struct('a', xxhash64(s.a, x), 'b', xxhash64(s.b, x, 1), 'out', concat(s.out, array(named_struct('a', s.a, 'b', s.b, 'part', x)))), s -> s.out)
"""
_NODE = ["host", "template", "step", "a", "b"]


def _same(left: DataFrame, keys: list[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, [left[k] == F.col(f"_{k}") for k in keys])


def _as_side(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"_{k}") for k in keys], *more)


def templates(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """pages (page_id, host, path, bad) with `template`: the path with its variable segments as wildcards.

    Only forks, nodes with many rare children, change a path. A round looks at all nodes that a path has left, up
    to its end, and takes each path through its next fork; so there are as many rounds as forks lie on one path, and
    a path of thousands of segments costs no round. Nodes are known by two hashes of the segments since the last fork.
    """
    rows = saved(pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "url-paths")
    rows = rows.select("id", "host", "path", "n", F.expr("split(regexp_replace(path, '^/', ''), '/')").alias("parts"), F.lit(0).alias("at"), F.lit("").alias("template"))
    ended = []
    for turn in itertools.count():
        nodes = rows.select("id", "host", "template", "n", F.posexplode(F.expr(_STEPS)).alias("step", "s")).select("id", "host", "template", "n", "step", "s.*")
        children = saved(nodes.groupBy(*_NODE, "part").agg(F.sum("n").alias("n")), f"url-children-{turn}")
        rare = F.col("n") <= p.few_pages
        forks = saved(_as_side(children.groupBy(*_NODE).agg(F.count_if(rare).alias("rare")).where(F.col("rare") >= p.min_children), _NODE), f"url-forks-{turn}")  # a plain table on that side lets Spark split a hot host's rows
        if forks.isEmpty():
            ended.append(rows)
            break
        next_fork = saved(nodes.join(forks, _same(nodes, _NODE), "left_semi").groupBy(F.col("id").alias("_id")).agg(F.min(F.struct("step", "a", "b", "part")).alias("fork")), f"url-next-{turn}")
        met = rows.join(next_fork, rows["id"] == F.col("_id"), "left").drop("_id")
        met = saved(met.select("*", "fork.*").drop("fork"), f"url-met-{turn}")
        ended.append(met.where("step is null").select(rows.columns))
        met = met.where("step is not null")
        named = children.where(~rare).join(forks, _same(children, _NODE), "left_semi")
        named = saved(_as_side(named, [*_NODE, "part"], F.lit(True).alias("named")), f"url-names-{turn}")
        met = met.join(named, _same(met, [*_NODE, "part"]), "left")
        passed = F.when(F.col("step") > 0, F.concat(F.lit("/"), F.array_join(F.expr("slice(parts, at + 1, step)"), "/"))).otherwise("")
        own = F.when(F.col("named"), F.concat(F.lit("/"), "part")).otherwise(F.lit("/*"))
        rows = saved(met.select("id", "host", "path", "n", "parts", (F.col("at") + F.col("step") + 1).alias("at"), F.concat("template", passed, own).alias("template")), f"url-turn-{turn}")
    rest = F.expr("slice(parts, at + 1, size(parts))")
    found = functools.reduce(DataFrame.unionByName, ended).withColumn("template", F.when(F.size("parts") > F.col("at"), F.concat("template", F.lit("/"), F.array_join(rest, "/"))).otherwise(F.col("template")))
    found = saved(_as_side(found, ["host", "path"], F.col("template")), "url-templates")
    return pages.join(found, _same(pages, ["host", "path"])).drop("_host", "_path")


#: A new branch starts where a bin of siblings differs from the branch's first bin by a test of two shares, each of a sibling of the bin's mean size.
_BRANCHES = """
aggregate(bins, named_struct('out', cast(array() as array<struct<bin: bigint, branch: bigint>>), 'bin', -1L, 'share', 0D, 'n', 0D),
  (a, b) -> if(a.bin >= 0 and b.share - a.share <= {z}D * sqrt(((a.share * a.n + b.share * b.n) / (a.n + b.n)) * (1D - (a.share * a.n + b.share * b.n) / (a.n + b.n)) * (1D / a.n + 1D / b.n)) + 1e-9D,
    named_struct('out', concat(a.out, array(named_struct('bin', b.bin, 'branch', a.bin))), 'bin', a.bin, 'share', a.share, 'n', a.n),
    named_struct('out', concat(a.out, array(named_struct('bin', b.bin, 'branch', b.bin))), 'bin', b.bin, 'share', b.share, 'n', b.n)),
  a -> a.out)
"""


def judged_templates(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per host and template: parent, branch (the merged siblings; -1 without labels), labelled, bad_share, verdict.

    Siblings meet as sums by bins of their shares, so a parent of any number of children is at most bins + 1 rows.
    """
    leaf = rows.groupBy("host", "template").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    leaf = leaf.withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    leaf = leaf.withColumn("bin", F.when(F.col("labelled") > 0, F.expr(f"{p.bins}L * bad div labelled")).otherwise(F.lit(-1)))
    leaf = saved(leaf, "url-leaves")
    bins = leaf.groupBy("host", "parent", "bin").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("kinds"))
    bins = saved(bins, "url-bins")
    parents = bins.groupBy("host", "parent").agg(
        F.sort_array(F.collect_list(F.when(F.col("bin") >= 0, F.struct("bin", (F.col("bad") / F.col("labelled")).alias("share"), (F.col("labelled") / F.col("kinds")).alias("n"))))).alias("bins"),
        F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    hosts = parents.groupBy("host").agg(F.sum("all_labelled").alias("host_labelled"), F.sum("all_bad").alias("host_bad"))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("host_bad") + p.prior * p.prior_bad) / (F.col("host_labelled") + p.prior)).alias("host_share"))
    parents = parents.join(hosts, F.col("host") == F.col("_host")).drop("_host")
    parents = parents.withColumn("parent_share", (F.col("all_bad") + p.prior * F.col("host_share")) / (F.col("all_labelled") + p.prior))
    steps = F.concat(F.expr(_BRANCHES.format(z=p.z)), F.array(F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(-1).cast("long").alias("branch"))))
    steps = parents.select(F.col("host").alias("_host"), F.col("parent").alias("_parent"), "parent_share", F.explode(steps).alias("step")).select("_host", "_parent", "parent_share", F.col("step.bin").alias("_bin"), "step.branch")
    of_bin = bins.join(steps, (F.col("host") == F.col("_host")) & (F.col("parent") == F.col("_parent")) & (F.col("bin") == F.col("_bin")))
    pooled = of_bin.groupBy("host", "parent", "branch", "parent_share").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.collect_list("bin").alias("members"))
    pooled = pooled.select(F.col("host").alias("_host"), F.col("parent").alias("_parent"), F.explode("members").alias("_bin"), "branch", F.col("labelled").alias("n"), ((F.col("bad") + p.prior * F.col("parent_share")) / (F.col("labelled") + p.prior)).alias("bad_share"))
    pooled = saved(pooled, "url-branches")
    out = leaf.join(pooled, (F.col("host") == F.col("_host")) & (F.col("parent") == F.col("_parent")) & (F.col("bin") == F.col("_bin")))
    return out.select("host", "template", "parent", "branch", F.col("n").alias("labelled"), "bad_share", F.when(F.col("bad_share") >= p.reject, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, p: Params = Params()) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, template, bad_share.

    `labels` has (page_id, bad 0/1). A page without a host is judged as host '' with an empty path; a null
    page_id has no label; of several labels of a page the worst counts. A template without labels has the
    share of its siblings, those without labels the host's, a host without labels the prior one, which allows. An empty table gives an empty result; other columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    marks = labels.groupBy(F.col("page_id").alias("_page")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rows = rows.join(marks, rows["page_id"] == marks["_page"], "left").drop("_page")
    rows = templates(saved(rows, "url-pages"), p)
    verdicts = saved(judged_templates(rows, p).select(F.col("host").alias("_host"), F.col("template").alias("_template"), "bad_share", "verdict"), "url-verdicts")
    rows = rows.join(verdicts, (rows["host"] == verdicts["_host"]) & (rows["template"] == verdicts["_template"]), "left")
    text, action = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", text.alias("rule"), F.coalesce(action, F.col("verdict")).alias("verdict"), "template", "bad_share")
