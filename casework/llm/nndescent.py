"""Near-duplicate vectors by NN-descent.

Equal vectors are one node. Random hyperplanes give every node a few first
neighbours; then each node introduces its neighbours to each other, and a list
keeps its best. A list that is saturated (its last neighbour is still above
the threshold) is enlarged to the whole connected group, counted block against
block. An audit compares some nodes with all others, more of them where links
are rare, and asks for further rounds until the recall is reached; without
evidence it is not, and all nodes are compared.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import quoted, stage
from .graph import components

log = logging.getLogger(__name__)

LEAST = 0.95
NEIGHBOURS = 8
# First neighbours: rows compared in sorted order of a bucket, kept of each hash table.
NEAR, KEPT = 10, 3
# Share of the pairs at the threshold that may meet in no table.
APART = 0.01
ROUNDS = 6
# A round that changes fewer lists than this share of the nodes is the last.
SETTLED = 0.002
# Members of a saturated group that a task compares with as many others.
BLOCK = 512
# Nodes asked inside enlarged groups, and as many outside; more, up to the second
# number, until so many of them have a link.
AUDITED, MOST_AUDITED = 256, 1 << 13
EVIDENCE = 64
RECALL = 0.98
EXTRA_ROUNDS = 3
# If the rounds do not reach the recall all nodes are compared with all, however
# many they are. With a number here more nodes than that are refused instead; no
# number makes a result of fewer comparisons.
EXACT_NODES: int | None = None
# Bytes of vectors in double precision of a block of that comparison, rows of a
# block at the most, and rows compared with the other block at a time.
EXACT_BYTES, EXACT_BLOCK, SLICE = 1 << 24, 1 << 13, 512


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all rows have as many components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _nodes(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(node, vec, weight, least id) for every distinct usable vector, and (row id, node) for every row."""
    v = quoted(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), v.alias("vec"), usable.alias("_usable"))
    rows = rows.withColumns({"_h1": F.xxhash64("vec"), "_h2": F.xxhash64(F.lit(1), "vec")})
    classes = rows.where("_usable").groupBy("_h1", "_h2").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    nodes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    usable_rows = rows.select("vec_id", "_h1", "_h2", "_usable")
    keys = nodes.select("_h1", "_h2", "node")
    members = usable_rows.join(keys, ["_h1", "_h2"], "left").select("vec_id", F.when(F.col("_usable"), F.col("node")).alias("node"))
    return nodes.select("node", "vec", F.size("vec").alias("dim"), "weight", "least"), members


def _hashing(count: int, least: float) -> tuple[int, int]:
    """Hash tables, and hyperplanes of each: a bucket of evenly spread nodes is about as large as
    the rows compared, and a pair at the threshold meets in a table with probability 1 - ``APART``."""
    planes = min(24, max(4, math.ceil(math.log2(max(count, 1) / (2 * NEAR)))))
    meet = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** planes
    return min(64, math.ceil(math.log(APART) / math.log1p(-meet))) if meet < 1 - APART else 1, planes


def _introductions(nodes: DataFrame, seed: int, count: int, least: float) -> DataFrame:
    """First neighbours (u, v, sim): nodes next to each other in a bucket of equal signs, sorted by a projection."""
    tables, signs = _hashing(count, least)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            for dim in np.unique(batch.column("dim")):
                part = batch.filter(pc.equal(batch.column("dim"), pa.scalar(int(dim), pa.int32())))
                x = _unit(part.column("vec"))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((tables, signs + 1, int(dim)))
                for t in range(tables):
                    y = x @ planes[dim][t].T
                    bucket = (y[:, :signs] > 0) @ (1 << np.arange(signs)) + (t << signs) + (int(dim) << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(y[:, signs]), part.column("node"), part.column("vec")], names=["bucket", "at", "node", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0] if tail is not None else batch
            bucket, node = batch.column("bucket").to_numpy(), batch.column("node").to_numpy()
            found = []
            for key in np.unique(bucket >> 32):
                at = np.flatnonzero(bucket >> 32 == key)
                x, b, n = _unit(batch.column("vec").take(pa.array(at))), bucket[at], node[at]
                sims = np.full((len(at), 2 * NEAR), -2.0)
                other = np.zeros((len(at), 2 * NEAR), np.int64)
                for o in range(1, min(NEAR, len(at) - 1) + 1):
                    s = np.where(b[o:] == b[:-o], (x[o:] * x[:-o]).sum(1), -2.0)
                    sims[o:, o - 1], other[o:, o - 1] = s, n[:-o]
                    sims[:-o, NEAR + o - 1], other[:-o, NEAR + o - 1] = s, n[o:]
                best = np.argsort(-sims, axis=1)[:, :KEPT]
                s, v = np.take_along_axis(sims, best, 1), np.take_along_axis(other, best, 1)
                u = np.repeat(n, KEPT).reshape(-1, KEPT)
                ok = s > -2
                found.append((u[ok], v[ok], s[ok]))
            u, v, s = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], names=["u", "v", "sim"])
            tail = batch.slice(max(0, batch.num_rows - NEAR))

    placed = nodes.select("node", "vec", "dim").mapInArrow(place, f"bucket long, at double, node long, vec {nodes.schema['vec'].dataType.simpleString()}")
    # By range, not by key: a bucket that holds many nodes is cut, which costs a few pairs at the cut.
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(parts, "bucket", "at").sortWithinPartitions("bucket", "at").mapInArrow(compare, "u long, v long, sim double")


def _best(edges: DataFrame) -> DataFrame:
    """The best neighbours of each node, each once."""
    once = edges.where("u <> v").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= NEIGHBOURS).select("u", "v", "sim", "place")


def _round(lists: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Pairs found by comparing all neighbours of a node with each other, if one of the two can use it."""
    last = lists.groupBy("u").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n"))
    worst = last.select(F.col("u").alias("node"), F.when(F.col("n") >= NEIGHBOURS, F.col("worst")).otherwise(F.lit(-2.0)).alias("worst"))
    # Of the nodes that list a node, about twice as many as it lists are asked,
    # others in each round.
    known = lists.groupBy("v").agg(F.count(F.lit(1)).alias("known"))
    chance = F.lit(2.0 * NEIGHBOURS) / F.col("known")
    back = lists.join(known, "v").where(F.pmod(F.xxhash64("u", "v", F.lit(turn)), F.lit(1 << 20)) < chance * (1 << 20))
    pairs = lists.select(F.col("u").alias("host"), F.col("v").alias("node")).union(back.select(F.col("v").alias("host"), F.col("u").alias("node")))
    pairs = pairs.union(lists.select(F.col("u").alias("host"), F.col("u").alias("node"))).distinct()
    guests = pairs.join(nodes.select("node", "vec"), "node").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None else batch
                host = held.column("host").to_numpy()
                cut = int(np.searchsorted(host, host[-1]))  # the last host may go on
                if cut:
                    yield compared(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None:
            yield compared(held)

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        host, node, worst = (batch.column(c).to_numpy() for c in ("host", "node", "worst"))
        x = _unit(batch.column("vec"))
        opens = np.append(np.flatnonzero(np.append(True, host[1:] != host[:-1])), len(host))
        out = []
        for a, b in zip(opens, opens[1:], strict=False):
            sims = x[a:b] @ x[a:b].T
            i, j = np.nonzero(sims > worst[a:b, None])
            out.append((node[a:b][i], node[a:b][j], sims[i, j]))
        u, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
        other = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[other]), pa.array(v[other]), pa.array(s[other])], names=["u", "v", "sim"])

    spark = nodes.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return guests.repartition(parts, "host").sortWithinPartitions("host").mapInArrow(meet, "u long, v long, sim double")


def _descended(lists: DataFrame, nodes: DataFrame, count: int, first: int) -> DataFrame:
    for turn in range(first, first + ROUNDS):
        after = stage(_best(lists.select("u", "v", "sim").union(_round(lists, nodes, turn))), "neighbours")
        changed = after.join(lists, ["u", "v"], "left_anti").select("u").distinct().count()
        lists = after
        if changed <= SETTLED * count:
            break
    return lists


def _group_links(group: DataFrame, nodes: DataFrame, least: float, size: int) -> DataFrame:
    """(node, links, root): links of the members of groups with a block of their group, and a
    member of the two blocks that they lead to; members without links in a block are left out."""
    sized = group.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    rows = group.join(sized, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    rows = rows.join(nodes.select("node", "vec", "weight"), "node")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["vec"].to_numpy()).astype(np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        own, weight, node = (frame[c].to_numpy() for c in ("own", "weight", "node"))
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for at in range(0, len(a), SLICE):
            part = a[at : at + SLICE]
            linked = (x[part] @ x[b].T >= least) & (node[part][:, None] != node[b][None, :])
            links[part] += linked @ weight[b]
            if i != j:
                links[b] += linked.T @ weight[part]
            p, q = np.nonzero(linked)
            # What earlier slices joined stays joined: each to its root so far.
            p, q = np.concatenate([part[p], np.arange(len(node))]), np.concatenate([b[q], root])
            while True:
                before = root.copy()
                np.minimum.at(root, p, before[q])
                np.minimum.at(root, q, before[p])
                if (root == before).all():
                    break
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some], "root": node[root[some]]})

    return rows.groupBy("component", "i", "j").applyInPandas(run, "node long, links long, root long")


def _group_counts(group: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(node, links): links of the members of saturated groups with all of their group, block by block."""
    return _group_links(group, nodes, least, BLOCK).groupBy("node").agg(F.sum("links").alias("links"))


def _all_pairs(nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, component) by comparing all nodes of as many components, block by block."""
    group = nodes.select("node", F.col("dim").cast("long").alias("component"))
    longest = nodes.agg(F.max("dim")).first()[0] or 1
    size = max(1, min(EXACT_BLOCK, EXACT_BYTES // (8 * longest)))
    found = stage(_group_links(group, nodes, least, size), "all-pairs")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    return found.groupBy("node").agg(F.sum("links").alias("links")), joined


def _outside_links(nodes: DataFrame, group: DataFrame, least: float, audited: int = AUDITED) -> DataFrame:
    """(u, v) for every link of the asked nodes that is not inside an enlarged group, by comparing them with all."""
    placed = nodes.join(group, "node", "left").select("node", "vec", "dim", "least", F.coalesce("component", F.lit(-1)).alias("component"))
    inside, every = F.col("component") >= 0, F.count(F.lit(1))
    sizes = placed.agg(F.count(F.when(inside, 1)).alias("inside"), every.alias("all")).first()
    chance = F.when(inside, audited / max(sizes["inside"], 1)).otherwise(audited / max(sizes["all"] - sizes["inside"], 1))
    asked = placed.where(F.pmod(F.xxhash64("node", "least"), F.lit(1 << 20)) < F.least(chance, F.lit(1.0)) * (1 << 20))
    shared = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["dim"], r["vec"], r["component"]) for r in asked.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in {d for _, d, _, _ in shared.value}:
                part = batch.filter(pc.equal(batch.column("dim"), pa.scalar(dim, pa.int32())))
                ids, held = (np.array([r[c] for r in shared.value if r[1] == dim]) for c in (0, 3))
                queries = _unit(pa.array([v for _, d, v, _ in shared.value if d == dim], pa.list_(pa.float64())))
                if part.num_rows:
                    node, component = part.column("node").to_numpy(), part.column("component").to_numpy()
                    apart = (held[:, None] != component) | (held[:, None] < 0)
                    i, j = np.nonzero((queries @ _unit(part.column("vec")).T >= least) & apart)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(node[j])], names=["u", "v"])

    return placed.select("node", "vec", "dim", "component").mapInArrow(run, "u long, v long").where("u <> v")


def _recall(nodes: DataFrame, group: DataFrame, links: DataFrame, least: float, count: int) -> tuple[float | None, int, int]:
    """The mean share of its links outside enlarged groups that is known of an asked
    node that has some, how many have, and how many nodes were asked at most.

    Too few with a link are no evidence: then more nodes are asked, and if
    that ends short of all nodes without enough of them the share is None.
    """
    audited = AUDITED
    while True:
        ends = _outside_links(nodes, group, least, audited).select("u", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        told = ends.join(links.withColumn("known", F.lit(1.0)), ["a", "b"], "left").groupBy("u").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("share"))
        mean, linked = told.agg(F.avg("share"), F.count(F.lit(1))).first()
        if linked >= EVIDENCE:
            return mean, linked, audited
        if audited >= count:
            return (1.0 if mean is None else mean), linked, audited
        if audited >= MOST_AUDITED:
            # A low share is evidence enough against the lists, a high one of few nodes is none for them.
            return (mean if mean is not None and mean < RECALL else None), linked, audited
        audited = min(audited * 8, MOST_AUDITED)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id that links lead to) and ``kept`` (it is that one).

    Vectors link at a cosine of ``least`` or more in double precision, and only
    if they have as many components. Null, empty and zero vectors and those
    with null or non-finite components link with nothing. Equal vectors link,
    rows that repeat an id as well. A null id is null in ``component_id`` where
    it stands alone. Other columns are not read. The rules are the same for any
    number of rows.
    """
    nodes, members = _nodes(vectors, id_col, vector)
    count = nodes.count()
    lists = stage(_best(_introductions(nodes, 1, count, least)), "neighbours")
    lists = _descended(lists, nodes, count, 1)
    before, extra = -1.0, 0
    while True:
        links = stage(lists.where(F.col("sim") >= least).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "links")
        joined = components(links)
        saturated = lists.where((F.col("place") == NEIGHBOURS) & (F.col("sim") >= least)).select(F.col("u").alias("node"))
        groups = joined.join(saturated, "node", "left_semi").select("component").distinct()
        group = stage(joined.join(groups, "component", "left_semi").select("node", "component"), "saturated")
        recall, linked, asked = _recall(nodes, group, links, least, count)
        told = "unknown" if recall is None else f"{recall:.4f}"
        log.warning("near_vectors: recall %s outside enlarged groups by %d linked nodes of up to %d asked, after %d further rounds", told, linked, 2 * asked, extra)
        if recall is None:
            break
        if recall >= RECALL or extra >= EXTRA_ROUNDS and recall <= before:
            break
        before, extra = recall, extra + 1
        more = lists.select("u", "v", "sim").union(_introductions(nodes, 1 + extra, count, least))
        lists = _descended(stage(_best(more), "neighbours"), nodes, count, 100 * extra)
    # Without evidence all are compared, as they are without the recall.
    if recall is not None and recall >= RECALL:
        # Lists that are not saturated hold all their links; the others are counted in their groups.
        both_ways = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        weights = nodes.select(F.col("node").alias("b"), "weight")
        listed = both_ways.join(group, both_ways["a"] == group["node"], "left_anti").join(weights, "b")
        listed = listed.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("links"))
        counted = reduce(DataFrame.unionByName, [listed, _group_counts(group, nodes, least)])
    elif EXACT_NODES is None or count <= EXACT_NODES:
        counted, joined = _all_pairs(nodes, least)
    else:
        raise RuntimeError(f"near_vectors: recall {told} of {RECALL} after {extra} further rounds on {count} distinct vectors")
    own = nodes.select("node", "weight", "least").join(counted, "node", "left").join(joined, "node", "left")
    own = own.withColumn("component", F.coalesce("component", "node"))
    root = own.groupBy("component").agg(F.min("least").alias("component_id"))
    own = stage(own.join(root, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-links")
    out = members.join(own, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
