"""How buckets of near-duplicates are settled, against all pairs."""

from collections import Counter

import numpy as np
import pytest

from casework.llm import bagminhash
from casework.llm.graph import components


def brute_groups(sets, least=0.8):
    """The smallest index that links lead to, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if sets[i] and m >= least * (len(sets[i]) + len(sets[j]) - m):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def random_sets(rng, n):
    base = [set(rng.integers(0, 1 << 62, 40).tolist()) for _ in range(4)]
    out = []
    for _ in range(n):
        of = base[int(rng.integers(4))]
        kept = {x for x in of if rng.random() < 0.95}
        out.append(kept | set(rng.integers(0, 1 << 62, int(rng.integers(0, 6))).tolist()))
    return out


def test_overlaps_and_connections(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(bagminhash, "COLUMNS", 16)
    for turn in range(40):
        sets = random_sets(rng, int(rng.integers(1, 40)))
        items = np.array([x for s in sets for x in s], np.int64)
        offsets = np.cumsum([0, *map(len, sets)])
        shared = bagminhash.overlaps(items, offsets)
        assert all(shared[i, j] == len(a & b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j), turn
        component = rng.integers(0, max(1, len(sets) // 2), len(sets))
        found = bagminhash.connections(component, items, offsets, 0.8)
        assert len(found) < len(set(component.tolist()))
        # The same sets as linking all pairs and all members of a component.
        want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if component[i] == component[j]}
        near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)}
        assert closed(want | near, len(sets)) == closed(want | set(found), len(sets)), turn


def closed(edges, n):
    root = list(range(n))
    for _ in range(n):
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)] + [(5001, 6000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    while True:
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts_around(rng, n_lines, n_copies):
    line = " ".join(f"common{k}" for k in range(14))
    texts = [line + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**7, 25)) for _ in range(n_lines)]
    base = [f"b{k}" for k in range(120)]
    for _ in range(n_copies):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, 4))):
            words[int(at)] = f"x{int(rng.integers(10**7))}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("block", "hub_pairs"), [(1024, 4096), (7, 11)])
def test_a_common_line_and_a_group_of_edited_copies(spark, monkeypatch, block, hub_pairs):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    monkeypatch.setattr(bagminhash, "HUB_PAIRS", hub_pairs)
    texts = texts_around(np.random.default_rng(3), 250, 150)
    values, owner = bagminhash.occurrences(*bagminhash.shingles(texts))
    sets = [set(values[owner == i].tolist()) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in bagminhash.near_duplicates(docs).collect()}
    want = brute_groups(sets)
    assert [got[i] for i in range(len(texts))] == want and max(Counter(want).values()) > 30


def test_work_on_a_large_group_grows_with_its_members(spark, monkeypatch):
    """Of 20,000 texts with one line and 5,000 edited copies of another text, no task gets a whole group."""
    blocks, hubs = [], []
    settled, verified = bagminhash._settled, bagminhash._verified

    def noted(rest, least):
        sizes = [r["count"] for r in rest.groupBy("bucket", "block").count().collect()]
        blocks.append((max(sizes, default=0), sum(sizes)))
        return settled(rest, least)

    def counted(pairs, sets, least):
        hubs.append(pairs.count())
        return verified(pairs, sets, least)

    monkeypatch.setattr(bagminhash, "_settled", noted)
    monkeypatch.setattr(bagminhash, "_verified", counted)
    texts = texts_around(np.random.default_rng(4), 20_000, 5_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    groups = Counter(r["group_id"] for r in bagminhash.near_duplicates(docs).collect())
    # Members that differ from most others by more than a fifth may stand alone; the others are one group.
    assert max(groups.values()) > 2_000 and sum(n == 1 for n in groups.values()) >= 20_000
    assert blocks[0][0] <= 2 * bagminhash.BLOCK and blocks[0][1] < 40 * len(texts) and hubs[0] < 33 * len(texts)
