"""Near-duplicate documents by a chosen-path set similarity join.

Every document becomes its set of distinct word shingles and TOKENS minwise tokens of it. Documents with
equal sets are one class from here on. In each of several independent trees the documents branch by the
values of randomly chosen tokens; a node that is still large picks further tokens, often a second one, so that
pairs at the threshold do not die out. The documents of a small node are compared
exhaustively: on tokens first, which gives coarse groups and loses a link only with the chance that
Params.margin leaves, then on full sets. Nodes that stay large at the last level hold near copies throughout:
there every document meets a pivot, and those that have no link with it meet the whole node, in blocks.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.graph import components
from feedlens.llm.shared import buffers, may_hold, saved, shingle_sets, short_batches, without


@dataclass(frozen=True)
class Params:
    percent: int = 85  #: a link: 100 * intersection >= percent * union
    width: int = 5  #: words of a shingle
    tokens: int = 64  #: minwise tokens of a document
    recall: float = 0.999  #: chance that a pair at the threshold meets in some tree, at any level down to the last
    spare: float = 0.25  #: share of nodes with a second token, beyond the share at which a pair at the threshold has one child with it on average
    leaf: int = 2048  #: documents of a node that are compared exhaustively
    depth: int = 12  #: levels after which a large node is dealt with by a pivot
    group: int = 256  #: documents of a coarse group that one task compares on full sets
    shingles: int = 4 << 20  #: shingles of all documents that a task holds at once; a larger group is met in blocks
    margin: float = 3.8  #: standard errors below the threshold at which token agreement still counts

    @property
    def trees(self) -> int:
        """Trees that reach the recall at the last level, on average over the tokens in which a pair at the threshold agrees."""
        s, n = self.percent / 100, self.tokens
        missed = [(math.comb(n, k) * s**k * (1 - s) ** (n - k), 1 - self.survival(k / n)) for k in range(n + 1)]
        return next(t for t in itertools.count(1) if sum(share * miss**t for share, miss in missed) <= 1 - self.recall)

    @property
    def second(self) -> float:
        """Share of the nodes below the first level that choose a second token."""
        return min(1.0, 100 / self.percent - 1 + self.spare)

    def survival(self, agree: float) -> float:
        """Chance that a pair which agrees in that share of its tokens is still together at the last level of one tree."""
        alive, two = 1.0, self.second * (1 - 1 / self.tokens)  # two picks may be the same token
        for _ in range(self.depth - 1):
            alive = agree * alive * (1 + two) - two * (agree * alive) ** 2
        return agree * alive

    @property
    def agreeing(self) -> int:
        """Tokens that must agree for two documents to be compared on full sets."""
        s = self.percent / 100
        return max(1, math.floor(self.tokens * s - self.margin * math.sqrt(self.tokens * s * (1 - s))))


# ---------------------------------------------------------------- sets and tokens


def _multipliers(n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x | np.uint64(1)


def minwise(flat: np.ndarray, first: np.ndarray, tokens: int) -> np.ndarray:
    """Minwise tokens, 32 bits each, of the non-empty sets that start at `first` in `flat`."""
    out = np.zeros((len(first), tokens), dtype=np.uint32)
    if len(first):
        for k, a in enumerate(_multipliers(tokens)):
            out[:, k] = np.minimum.reduceat(flat * a, first) >> np.uint64(32)
    return out


def _signatures(p: Params):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a in range(0, batch.num_rows, 256):
                b = min(a + 256, batch.num_rows)
                sets = list(shingle_sets(data, offsets[a : b + 1], p.width))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                tokens = minwise(np.concatenate(sets), (np.cumsum(sizes) - sizes)[full], p.tokens).view(np.int32)
                ends = np.cumsum(np.where(sizes > 0, p.tokens, 0))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(sizes, pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(tokens.reshape(-1), pa.int32())),
                ], ["doc_id", "key", "n_shingles", "digest", "tokens"])

    return run


def signatures(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, digest of the set, tokens (empty for an empty set) of rows (doc_id, key, text)."""
    short_batches(docs.sparkSession)
    return docs.select("doc_id", "key", "text").mapInArrow(_signatures(p), "doc_id long, key long, n_shingles long, digest binary, tokens array<int>")


# ---------------------------------------------------------------- trees


def _branch(rows: DataFrame, p: Params, extra: float) -> DataFrame:
    """rows (node, doc_id, tokens) one level down: a second token is chosen in a share `extra` of the nodes."""
    pick = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(p.tokens)).cast("int")
    second = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(1_000_000)) < int(extra * 1_000_000)
    chosen = F.when(second & (pick("a") != pick("b")), F.array(pick("a"), pick("b"))).otherwise(F.array(pick("a")))
    down = rows.select("doc_id", "tokens", "node", F.explode(chosen).alias("at"))
    return down.select(F.xxhash64("node", "at", F.get("tokens", F.col("at"))).alias("node"), "doc_id", "tokens")


def leaves(reps: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame | None]:
    """(node, doc_id) of nodes of 2 to p.leaf documents, and of the larger ones that are left at the last level."""
    roots = F.explode(F.array(*[F.xxhash64(F.lit(f"tree {t}")) for t in range(p.trees)]))
    rows = reps.select("doc_id", "tokens", roots.alias("node"))
    done = []
    for level in range(p.depth):
        rows = _branch(rows, p, p.second if level else 0.0).select("node", "doc_id")
        sizes = saved(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("members")).where("n > 1"), "path-sizes")
        # Of small nodes with the same documents one is enough.
        keep = sizes.where(F.col("n") <= p.leaf).groupBy("n", "members").agg(F.min("node").alias("node"))
        keep = keep.select("node", "n").unionByName(sizes.where(F.col("n") > p.leaf).select("node", "n")).withColumnRenamed("node", "_node")
        live = saved(rows.join(keep, F.col("node") == F.col("_node")).select("node", "doc_id", "n"), "path-nodes")
        done.append(live.where(F.col("n") <= p.leaf).select("node", "doc_id"))
        large = live.where(F.col("n") > p.leaf)
        if large.isEmpty():
            large = None
            break
        large = large.select("node", "doc_id")
        tokens = reps.select(F.col("doc_id").alias("_doc"), "tokens")
        rows = large.join(tokens, F.col("doc_id") == F.col("_doc")).select("node", "doc_id", "tokens")
    small = done[0]
    for more in done[1:]:
        small = small.unionByName(more)
    return small, large


def runs(batches, key: str) -> Iterator:
    """Tables of whole keys, about a batch each, from batches in order of the key."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = int(np.flatnonzero(keys.to_numpy(zero_copy_only=False) == keys[-1].as_py())[0]) if keys[0].as_py() != keys[-1].as_py() else 0
        if held and keys[0].as_py() != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component, of edges between 0..n-1."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    while (label[label] != label).any():
        label = label[label]
    return label


def _statements(ids: np.ndarray, label: np.ndarray):
    import pyarrow as pa

    linked = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(ids[linked], pa.int64()), pa.array(ids[label[linked]], pa.int64())], ["u", "v"])


def _positions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row in its run of equal keys, and the run's length."""
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    length = np.diff(np.append(heads, len(keys)))
    return np.arange(len(keys)) - np.repeat(heads, length), np.repeat(length, length)


def _by_tokens(p: Params):
    """Rows (node, doc_id, tokens) in order of node: statements (u, v) that two documents are of one coarse group."""
    def run(batches):
        for table in runs(batches, "node"):
            table = table.combine_chunks()
            place, length = _positions(table.column("node").to_numpy())
            tokens = table.column("tokens").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p.tokens)
            left, right = [], []
            for d in range(1, int(length.max())):
                i = np.flatnonzero(place + d < length)
                for a in range(0, len(i), 1 << 14):
                    part = i[a : a + (1 << 14)]
                    near = part[(tokens[part] == tokens[part + d]).sum(axis=1, dtype=np.uint16) >= p.agreeing]
                    left.append(near)
                    right.append(near + d)
            if left:
                yield _statements(table.column("doc_id").to_numpy(), _labels(len(place), np.concatenate(left), np.concatenate(right)))

    return run


def _linked(sets: list[np.ndarray], percent: int, rows: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (i of `rows`, else all; j) with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    names, number = np.unique(flat, return_inverse=True)
    first = np.cumsum(sizes) - sizes
    mark = np.zeros(len(names), dtype=np.int64)
    left, right = [], []
    for i in rows if rows is not None else range(len(sets)):
        own = number[first[i] : first[i] + sizes[i]]
        mark[own] = 1
        j = np.flatnonzero((100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & (np.arange(len(sets)) != i))
        if rows is None:
            j = j[j > i]
        if len(j):
            at = np.repeat(first[j] - (np.cumsum(sizes[j]) - sizes[j]), sizes[j]) + np.arange(sizes[j].sum())
            both = np.add.reduceat(mark[number[at]], np.cumsum(sizes[j]) - sizes[j])
            j = j[100 * both >= percent * (sizes[j] + sizes[i] - both)]
            left.append(np.full(len(j), i))
            right.append(j)
        mark[own] = 0
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _by_sets(key: str, p: Params):
    """Rows (key, doc_id, text) in order of key: statements (u, v) that full sets confirm."""
    def run(batches):
        for table in runs(batches, key):
            table = table.combine_chunks()
            place, length = _positions(table.column(key).to_numpy())
            ids = table.column("doc_id").to_numpy()
            data, offsets = buffers(table.column("text"))
            at = 0
            while at < len(place):
                n = int(length[at])
                own = ids[at : at + n]
                sets = list(shingle_sets(data, offsets[at : at + n + 1], p.width))
                yield _statements(own, _labels(n, *_linked(sets, p.percent)))
                at += n

    return run


# ---------------------------------------------------------------- large nodes


def _large_nodes(large: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Confirmed statements (u, v) of nodes of any size: all links of the node are implied by them.

    A node's pivot is its least document. The documents that have a link with it are in one component
    already. Each other document meets every block of the node. Blocks have p.leaf documents and p.shingles
    shingles or so, so no task holds a node. Rows of `large` are (node, doc_id, size), size in shingles.
    """
    blocks = F.ceil(F.greatest(F.col("n") / (p.leaf / 2), F.col("size") / p.shingles)).cast("int")
    pivots = large.groupBy("node").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    pivots = saved(pivots.select("node", "pivot", blocks.alias("blocks")), "path-pivots")
    rows = large.join(pivots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "node"), F.col("blocks")).cast("int"))
    rows = saved(rows, "path-large")
    # The pivot goes to each block of its node.
    centre = rows.where("doc_id = pivot").select("node", "doc_id", "size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    member = rows.where("doc_id <> pivot").select("node", "doc_id", "size", "block", F.lit(1).alias("kind"))
    stars = saved(_meet(centre.withColumn("kind", F.lit(0)).unionByName(member), texts, p), "path-stars")
    covered = stars.select(F.col("u").alias("_doc"), F.col("v").alias("_pivot")).distinct()
    rest = rows.where("doc_id <> pivot").join(covered, (F.col("doc_id") == F.col("_doc")) & (F.col("pivot") == F.col("_pivot")), "left_anti")
    visits = rest.select("node", "doc_id", "size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"))
    return stars.unionByName(_meet(visits.unionByName(rows.select("node", "doc_id", "size", "block", F.lit(1).alias("kind"))), texts, p))


def _meet(rows: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Confirmed pairs (visitor or resident, visitor) of rows (node, block, doc_id, size, kind), kind 0 a visitor."""
    def run(batches):
        import pyarrow as pa

        pair, visitors = None, []
        for batch in batches:
            ids, kinds, keys = batch.column("doc_id").to_numpy(), batch.column("kind").to_numpy(), batch.column("pair").to_numpy()
            sets = shingle_sets(*buffers(batch.column("text")), p.width)
            u, v = [], []
            for own, kind, key, values in zip(ids, kinds, keys, sets, strict=True):
                if key != pair:
                    pair, visitors = key, []
                for other, theirs in visitors:
                    if other != own and 100 * min(len(values), len(theirs)) >= p.percent * max(len(values), len(theirs)):
                        both = len(np.intersect1d(values, theirs, assume_unique=True))
                        if 100 * both >= p.percent * (len(values) + len(theirs) - both):
                            u.append(own)
                            v.append(other)
                if kind == 0:
                    visitors.append((own, values))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    # Visitors of a block are dealt to batches of p.leaf documents and p.shingles shingles, so what a task holds of them is bounded.
    visitor = lambda x: F.sum(F.when(F.col("kind") == 0, x).otherwise(0)).over(_block())
    groups = F.greatest(F.lit(1), F.ceil(visitor(F.lit(1)) / p.leaf), F.ceil(visitor(F.col("size")) / p.shingles)).cast("int")
    rows = rows.withColumn("groups", groups)
    spread = F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("groups") - 1))
    rows = rows.select("node", "block", "doc_id", "kind", F.explode(spread).alias("group"))
    rows = rows.select(F.xxhash64("node", "block", "group").alias("pair"), "doc_id", "kind")
    full = rows.join(texts.select(F.col("doc_id").alias("_doc"), "text"), F.col("doc_id") == F.col("_doc")).drop("_doc")
    return full.repartition("pair").sortWithinPartitions("pair", "kind").mapInArrow(run, "u long, v long")


def _block():
    from pyspark.sql import Window as W

    return W.partitionBy("node", "block")


# ---------------------------------------------------------------- the operator


def link(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id that links reach. Null text and text without words have an empty set
    and are linked with nothing; a null doc_id is its own component and is kept. Rows that repeat a doc_id
    share its component, and all their texts' links count for it. An empty table gives an empty result; other
    columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    table = saved(signatures(texts, p), "path-signatures")
    repeats = _repeats(table)
    full = table.where("n_shingles > 0 and doc_id is not null")
    # A class has a number of its own from here on, and one row's text stands for it.
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("row"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("size"), F.first("tokens").alias("tokens"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("class"), "digest", F.col("row.doc_id").alias("rep"), F.col("row.key").alias("key"), "n", "size", "tokens"), "path-classes")
    small, large = leaves(classes.select(F.col("class").alias("doc_id"), "tokens"), p)

    tokens = classes.select(F.col("class").alias("_doc"), "tokens")
    near = small.join(tokens, F.col("doc_id") == F.col("_doc")).select("node", "doc_id", "tokens")
    coarse = near.repartition("node").sortWithinPartitions("node").mapInArrow(_by_tokens(p), "u long, v long")
    coarse = components(coarse)
    groups = saved(coarse.select(F.col("u").alias("doc_id"), F.col("v").alias("coarse")).unionByName(coarse.select(F.col("v").alias("doc_id"), F.col("v").alias("coarse")).distinct()), "path-groups")
    about = classes.select(F.col("class").alias("_doc"), F.col("rep").alias("_rep"), F.col("key").alias("_key"), "size")
    groups = groups.join(about, F.col("doc_id") == F.col("_doc")).select("doc_id", "coarse", "size")
    sizes = saved(groups.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).withColumnRenamed("coarse", "_coarse"), "path-group-sizes")
    member = saved(groups.join(sizes, F.col("coarse") == F.col("_coarse")).select("doc_id", "coarse", "size", "n", "total"), "path-members")

    # Small groups meet in one task; large ones node by node; what holds too many shingles for a task meets in blocks.
    one = member.where((F.col("n") <= p.group) & (F.col("total") <= p.shingles)).select(F.col("coarse").alias("node"), "doc_id")
    heavy = [member.where((F.col("n") <= p.group) & (F.col("total") > p.shingles)).select(F.col("coarse").alias("node"), "doc_id", "size")]
    over = member.where(F.col("n") > p.group).select(F.col("doc_id").alias("_over"), "size")
    if not over.isEmpty():
        nodes = saved(small.join(over, F.col("doc_id") == F.col("_over")).select("node", "doc_id", "size"), "path-over")
        weight = nodes.groupBy(F.col("node").alias("_node")).agg(F.sum("size").alias("total"))
        nodes = nodes.join(weight, F.col("node") == F.col("_node"))
        one = one.unionByName(nodes.where(F.col("total") <= p.shingles).select("node", "doc_id"))
        heavy.append(nodes.where(F.col("total") > p.shingles).select("node", "doc_id", "size"))
    if large is not None:
        heavy.append(large.join(about, F.col("doc_id") == F.col("_doc")).select("node", "doc_id", "size"))
    heavy = saved(functools.reduce(DataFrame.unionByName, heavy), "path-heavy")

    met = member.select("doc_id") if large is None else member.select("doc_id").unionByName(large.select("doc_id"))
    wanted = saved(about.join(met.distinct(), F.col("doc_id") == F.col("_doc"), "left_semi"), "path-wanted")
    text = texts.where("doc_id is not null").where(may_hold(wanted.select("_rep"), F.col("doc_id")))
    text = text.join(wanted, (F.col("doc_id") == F.col("_rep")) & (F.col("key") == F.col("_key"))).select("_doc", "text")
    if repeats:
        text = text.dropDuplicates(["_doc"])
    links = one.join(text, F.col("doc_id") == F.col("_doc")).select("node", "doc_id", "text").repartition("node").sortWithinPartitions("node").mapInArrow(_by_sets("node", p), "u long, v long")
    if not heavy.isEmpty():
        links = links.unionByName(_large_nodes(heavy, text.withColumnRenamed("_doc", "doc_id"), p))
    if repeats:  # the classes of one doc_id are one component
        own = full.select("doc_id", "digest").join(classes.select(F.col("digest").alias("_digest"), "class"), F.col("digest") == F.col("_digest"))
        least = own.groupBy(F.col("doc_id").alias("_doc")).agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most")
        links = links.unionByName(own.join(least, F.col("doc_id") == F.col("_doc")).where("class > least").select(F.col("class").alias("u"), F.col("least").alias("v")).distinct())
    found = components(links)
    found = found.select(F.col("u").alias("_class"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("_class"), F.col("v").alias("root")).distinct())

    # Classes of one row without links are their own components; the others are looked up.
    final = classes.select("digest", "rep", "class", "n").join(found, F.col("class") == F.col("_class"), "left").where("n > 1 or root is not null").select("digest", "rep", F.coalesce("root", "class").alias("root"))
    final = saved(final, "path-roots")
    roots = final.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("component"))
    final = saved(final.join(roots, F.col("root") == F.col("_root")).select(F.col("digest").alias("_digest"), "component"), "path-final")
    rows = table.select("doc_id", "n_shingles", "digest")
    out = rows.join(final, (F.col("digest") == F.col("_digest")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left").select("doc_id", "n_shingles", "component")
    if repeats:  # a row of an empty set has the component of its doc_id's other rows
        whole = out.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.min("component").alias("_least"))
        out = out.join(whole, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "n_shingles", F.coalesce("component", "_least").alias("component"))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _repeats(table: DataFrame) -> bool:
    """Whether a doc_id occurs on several rows."""
    return not table.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def deduplicate(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that stay, with all their columns: one document of each component.

    Of rows that repeat the doc_id of the document that stays, one stays.
    """
    from pyspark.sql import Window as W

    gone = saved(link(docs, p).where(~F.col("kept")).select("doc_id").distinct(), "path-gone")
    stays = without(docs, gone)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return stays
    stays = stays.select(F.struct(*[stays[c] for c in stays.columns]).alias("row"), stays["doc_id"].cast("long").alias("_doc"))
    turn = F.row_number().over(W.partitionBy("_doc").orderBy(F.xxhash64("row")))
    return stays.withColumn("turn", turn).where("turn = 1 or _doc is null").select("row.*")
