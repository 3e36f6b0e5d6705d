"""Near-duplicate texts by weighted Jaccard similarity of their word shingles.

A text is the multiset of its five-word shingles. Signatures come from a
Poisson process over (weight, time) for every shingle: weight is cut into unit
steps, grouped into stretches of doubling width, and a point of a stretch
counts if its weight coordinate lies below the shingle's multiplicity. Each
point falls into one register, which keeps its earliest. Points are made in
order of time and only while they can still change a register, so a text
needs little more than one point per shingle. Two texts agree in a register
with a probability that equals their weighted Jaccard similarity.

Registers are banded into buckets. In each bucket one class, the one that meets
most others over all buckets, is compared with the rest by exact multiset
overlap: in a group of edited copies that is the text they come from. Members that remain apart
are then settled among themselves, block by block, so no link is lost to a
poor choice of the first. A block counts all overlaps at once, as a product of
its incidence matrix, and tells only what it connects: no pair list of a group is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import HotKeys
from .common import brought_back, id_filter, id_key, quoted, set_apart, stage, text_slices
from .graph import components
from .words import LETTERS, U, mix, text_windows, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 128
# At 0.8 a pair shares no bucket with a probability of 5e-8.
BANDS = 32
# Members that one task compares with each other at most, per block.
BLOCK = 1024
# Pairs of one hub that one task of a join takes, about.
HUB_PAIRS = 4096
# Distinct items that an incidence matrix has at a time.
COLUMNS = 2048
# Points that a round makes in all, while few cells are left.
ROUND_POINTS = 1 << 15


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, the text of each and how often it has it, by text.

    Words are runs of letters and digits in lower case. A text of fewer words
    has one shingle of all of them, a text without words none.
    """
    words, first = word_hashes([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], LETTERS)
    found, owner = text_windows(words, first, size)
    lengths = np.diff(first)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        whole = [_joined(words[first[i] : first[i + 1]]) for i in short]
        found, owner = np.concatenate([found, np.array(whole, U)]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    opens = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))) if len(found) else np.empty(0, np.int64)
    return found[opens], owner[opens], np.diff(np.append(opens, len(found)))


def _joined(words: np.ndarray) -> np.uint64:
    out = np.array([len(words)], U)
    for word in words:
        out = mix(out * U(31) + word)
    return out[0]


def _cells(found: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of weight [0, 1), [1, 2), [2, 4), [4, 8) ... that each multiplicity reaches."""
    seeds, owners, low, width, limit = [mix(found)], [owner], [np.zeros(len(found))], [np.ones(len(found))], [counts]
    begin = 1
    while len(at := np.flatnonzero(counts > begin)):
        seeds.append(mix(found[at] + mix(np.array([begin], U))))
        owners.append(owner[at])
        low.append(np.full(len(at), float(begin)))
        width.append(np.full(len(at), float(begin)))
        limit.append(counts[at])
        begin *= 2
    return tuple(map(np.concatenate, (seeds, owners, low, width, limit)))


def signatures(found: np.ndarray, owner: np.ndarray, counts: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """One row of 32-bit registers per text; a text without shingles has zeros."""
    best = np.full((texts, registers), np.inf)
    flat = best.reshape(-1)
    seed, owner, low, width, limit = _cells(found, owner, counts)
    time = np.zeros(len(seed))
    made = 0
    while len(seed):
        n = min(512, max(1, ROUND_POINTS // len(seed)))
        draw = mix(seed[:, None] + np.arange(2 * made + 1, 2 * (made + n) + 1, dtype=U) * U(0x9E3779B97F4A7C15))
        made += n
        gap = -np.log(((draw[:, ::2] >> U(11)).astype(float) + 0.5) / (1 << 53)) / width[:, None]
        # Added up one by one from the first point on, so the bits do not depend on n.
        gap[:, 0] += time
        when = np.cumsum(gap, axis=1)
        place = draw[:, 1::2]
        register = (place % U(registers)).astype(np.int64) + owner[:, None] * registers
        weight = low[:, None] + (place >> U(16)).astype(float) / (1 << 48) * width[:, None]
        counted = weight < limit[:, None]
        np.minimum.at(flat, register[counted], when[counted])
        time = when[:, -1]
        live = time < best.max(axis=1)[owner]
        seed, owner, low, width, limit, time = (x[live] for x in (seed, owner, low, width, limit, time))
    out = (mix(flat.view(U)) >> U(32)).astype(np.uint32)
    out[np.isinf(flat)] = 0
    return out.reshape(texts, registers)


def occurrences(found: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multiset as a set: one value per occurrence, and its text."""
    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(found, counts) + turn.astype(U) * U(0x2545F4914F6CDD1D)), np.repeat(owner, counts)


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in text_slices(batch, "_text"):
                parts = shingles(texts)
                rows = signatures(*parts, len(texts))
                any_word = np.bincount(parts[1], minlength=len(texts)) > 0
                signature = pa.array([r.tobytes() if ok else None for r, ok in zip(rows, any_word, strict=True)], pa.binary())
                kept = [keys.column(c) for c in ("doc_id", "_k", "_text_id")]
                yield pa.RecordBatch.from_arrays([*kept, signature], names=["doc_id", "_k", "_text_id", "_sig"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _k long, _text_id binary, _sig binary")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in text_slices(batch, "_text"):
                values, owner = occurrences(*shingles(texts))
                offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([keys.column("node"), sets], names=["node", "items"])

    return docs.mapInArrow(run, "node long, items array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose multisets overlap enough, by exact count. A node may be
    the ``a`` of any number of pairs: beyond ``HUB_PAIRS`` they are dealt over parts."""
    pairs = stage(pairs, "pairs")
    parts = F.ceil(F.col("n") / HUB_PAIRS).cast("int").alias("_parts")
    hot = HotKeys.of(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_PAIRS).select("a", parts), ["a"])
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    of_a, on = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), ["a"]
    if hot is not None:
        dealt, on = F.coalesce("_parts", F.lit(1)), ["a", "part"]
        with_b = hot.added_to(with_b).withColumn("part", F.pmod(F.xxhash64("b"), dealt).cast("int")).drop("_parts")
        of_a = hot.added_to(of_a).withColumn("part", F.explode(F.sequence(F.lit(0), dealt - 1))).drop("_parts")
    both = with_b.join(of_a, on)
    sizes = F.size("x"), F.size("y")
    # The sizes alone rule out many pairs.
    both = both.where(F.least(*sizes) >= least * F.greatest(*sizes))
    met = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("m"), (sizes[0] + sizes[1]).alias("n"))
    return met.where(F.col("m") >= least * (F.col("n") - F.col("m"))).select("a", "b")


def _labels(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node within two links. Nodes of one label
    are connected; connected nodes may have several."""
    both = links.union(links.select("b", "a"))
    near = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    further = both.join(near.select(F.col("node").alias("b"), "component"), "b")
    return further.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("component"))


def overlaps(items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many items every two of n sets share; ``items`` are those of all sets, one after the other."""
    n = len(offsets) - 1
    values, code = np.unique(items, return_inverse=True)
    several = np.bincount(code, minlength=len(values)) > 1
    # An item of one set alone is shared with none.
    number = np.cumsum(several) - 1
    held = several[code]
    owner, column = np.repeat(np.arange(n), np.diff(offsets))[held], number[code[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    for start in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        incidence = np.zeros((n, COLUMNS), np.float32)
        incidence[owner[a:b], column[a:b] - start] = 1
        out += incidence @ incidence.T
    return out


def connections(component: np.ndarray, items: np.ndarray, offsets: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Members (i, j) of two components each, enough to connect all components that similar members lead to."""
    firsts, group = np.unique(component, return_index=True, return_inverse=True)[1:]
    shared, sizes = overlaps(items, offsets).astype(np.float64), np.diff(offsets)
    near = shared >= least * (sizes[:, None] + sizes[None, :] - shared)
    p, q = (group[i] for i in np.nonzero(near & (group[:, None] != group[None, :])))
    root = np.arange(len(firsts))
    while True:
        before = root.copy()
        np.minimum.at(root, p, before[q])
        if (root == before).all():
            break
    return [(int(firsts[r]), int(firsts[c])) for c, r in enumerate(root.tolist()) if r != c]


def _settled(rest: DataFrame, least: float) -> DataFrame:
    """Links that connect what members of a block of a bucket have in common
    beyond their components. Rows: bucket, block, node, component, items."""
    names = ["bucket", "block", "node", "component", "items"]

    def links(group: pa.Table) -> Iterator[pa.RecordBatch]:
        column = group.column("items").combine_chunks()
        offsets = column.offsets.to_numpy().astype(np.int64)
        items = column.values.to_numpy()[offsets[0] : offsets[-1]]
        node = group.column("node").to_numpy()
        found = connections(group.column("component").to_numpy(), items, offsets - offsets[0], least)
        if found:
            a, b = (node[list(c)] for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            bucket, block = (held.column(c).to_numpy() for c in names[:2])
            turns = (np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
            # The last group may go on in the next batch.
            for start, stop in zip([0, *turns], turns, strict=False):
                yield from links(held.slice(start, stop - start))
            if turns:
                held = held.slice(turns[-1])
        if held is not None:
            yield from links(held)

    rows = rest.select(*names).repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: its id, ``class_id`` (smallest id with the same
    text), ``group_id`` (smallest id that links of ``least`` or more lead to)
    and ``kept`` (it is the group's first).

    A null text counts as empty; texts without a word link with nothing but
    equal ones. A null id takes a key made from its text, shown as
    ``class_id`` and ``group_id``. Groups are of texts: rows that share an id
    but not a text may be in different groups. Other columns are not read.
    """
    return _grouped(docs, id_col, text, least).select("doc_id", "class_id", "group_id", "kept")


def _text_id(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(quoted(text), F.lit("")), 256))


def _grouped(docs: DataFrame, id_col: str, text: str, least: float) -> DataFrame:
    """The rows of ``near_duplicates`` with the key and the text that tell them apart."""
    read = docs.select(quoted(id_col).alias("doc_id"), id_key(docs, id_col, text).alias("_k"), F.coalesce(quoted(text), F.lit("")).alias("_text"))
    signed = stage(_signed(read.withColumn("_text_id", _text_id("_text"))), "signatures")
    classes = signed.groupBy("_text_id").agg(F.min("_k").alias("class_id"))
    # Every text is a node of its own, also if an id repeats with several texts.
    repeated = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.when(F.col("n").isNull(), F.col("class_id")).otherwise(-1 - F.pmod(F.xxhash64("_text_id"), F.lit(1 << 62)))
    classes = stage(classes.join(repeated, "class_id", "left").select("_text_id", "class_id", own.alias("node")), "classes")
    first = classes.withColumnRenamed("class_id", "_k")
    rows = signed.select("doc_id", "_k", "_text_id")
    signed = signed.where("_sig is not null").join(first, ["_k", "_text_id"]).select("node", "_sig")
    width = 4 * REGISTERS // BANDS
    band = F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(_sig, i * {width} + 1, {width})))"))
    banded = signed.select("node", band.alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(banded.join(shared, "bucket"), "buckets")
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = met.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
    crowd = stage(met.drop("n").join(hubs.select("bucket", (-F.col("top.minus")).alias("hub")), "bucket"), "hubs")

    involved = crowd.select("node").distinct()
    asked = stage(first.join(involved, "node", "left_semi"), "asked")
    maybe = id_filter(asked, "_k")
    texts = read.where(maybe(F.col("_k"))).withColumn("_text_id", _text_id("_text")).join(asked, ["_k", "_text_id"])
    sets = stage(_sets(texts.dropDuplicates(["_k", "_text_id"]).select("node", "_text")), "shingle-sets")
    pairs = crowd.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(_verified(pairs, sets, least), "links")
    labels = _labels(links)

    # Buckets whose members are not all connected yet; of those with the same members one is enough.
    placed = crowd.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    h = F.xxhash64("node")
    open_ = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"), F.min("component").alias("c"), F.max("component").alias("d")
    )
    open_ = open_.where("n > 2 and c <> d").groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket"))
    open_ = open_.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = placed.join(open_, "bucket").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    # A member meets every block once: block (i, j) holds the members of i and of j.
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    rest = rest.withColumn("other", other).withColumn("block", F.least("own", "other") * F.lit(1 << 20) + F.greatest("own", "other"))
    more = _settled(rest.select("bucket", "block", "node", "component").join(sets, "node"), least)
    final = components(stage(links.union(more), "all-links"))
    linked = classes.select("node", "class_id").join(final, "node")
    heads = linked.groupBy("component").agg(F.min(F.struct("class_id", "node")).alias("head"))
    named = linked.join(heads, "component").select("node", F.col("head.class_id").alias("group_id"), F.col("head.node").alias("head"))
    placed = classes.join(named, "node", "left").withColumns({"group_id": F.coalesce("group_id", "class_id"), "first": F.coalesce("head", "node") == F.col("node")})
    kept = F.col("first") & (F.col("_k") == F.col("class_id"))
    return rows.join(placed, "_text_id").select("doc_id", "_k", "_text_id", "class_id", "group_id", kept.alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, and of
    rows that repeat that id with that text one. Only rows that may have to go
    are shuffled. All columns stay, whatever their names."""
    found = stage(_grouped(docs, id_col, text, least).select("_k", "_text_id", "kept"), "groups")
    apart, names = set_apart(docs)
    return brought_back(_keep_first(apart, found, names[id_col], names[text]), names)


def _keep_first(docs: DataFrame, found: DataFrame, id_col: str, text: str) -> DataFrame:
    rows = found.groupBy("_k", "_text_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    doubtful = stage(rows.where("not kept or n > 1").select("_k", "_text_id", "kept"), "doubtful")
    maybe = id_filter(doubtful, "_k")
    marked = docs.withColumn("_maybe", maybe(id_key(docs, id_col, text)))
    sure = marked.where(~F.col("_maybe")).drop("_maybe")
    rest = marked.where("_maybe").withColumns({"_k": id_key(docs, id_col, text), "_text_id": _text_id(text)})
    rest = rest.join(doubtful.where("not kept"), ["_k", "_text_id"], "left_anti").dropDuplicates(["_k", "_text_id"])
    return sure.unionByName(rest.select(*map(quoted, docs.columns)))
