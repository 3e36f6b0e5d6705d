"""The audit of the neighbour graph where links are rare."""

import logging

import numpy as np
import pytest

from casework.llm import nndescent


def sparse(n=4000, pairs=8, seed=6):
    """Vectors of which 0.4 % have a link."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 24))
    twins = x[:pairs] + 0.02 * rng.standard_normal((pairs, 24))
    return np.concatenate([x, twins])


def linked(rows):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows if r["n_links"]}


def expected(x):
    unit = x.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    return {int(i): (int(near[i].sum()), int(min(i, *np.flatnonzero(near[i])))) for i in np.flatnonzero(near.any(1))}


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_withheld_links_are_noticed_where_links_are_rare(spark, monkeypatch, caplog):
    x = sparse()
    first = nndescent._introductions

    def none_of_the_twins(nodes, *more):
        return first(nodes.where("least < 4000 and least >= 8"), *more)

    monkeypatch.setattr(nndescent, "_introductions", none_of_the_twins)
    monkeypatch.setattr(nndescent, "MOST_AUDITED", 1024)
    with caplog.at_level(logging.WARNING):
        got = linked(nndescent.near_vectors(frame(spark, x)).collect())
    assert got == expected(x) and len(got) == 16
    # Some asked nodes may have met a withheld link, which counts against the lists; none is no evidence for them.
    assert "recall 1.0000" not in caplog.text and "asked" in caplog.text


def test_links_that_are_known_pass_once_enough_nodes_are_asked(spark, monkeypatch, caplog):
    x = sparse(n=1500, pairs=60)
    compared = []
    every = nndescent._all_pairs
    monkeypatch.setattr(nndescent, "_all_pairs", lambda *a: compared.append(1) or every(*a))
    with caplog.at_level(logging.WARNING):
        got = linked(nndescent.near_vectors(frame(spark, x)).collect())
    assert got == expected(x) and len(got) == 120
    assert "recall 1.0000" in caplog.text and not compared


def test_double_precision_vectors_are_taken(spark):
    x = sparse(n=60, pairs=5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert linked(nndescent.near_vectors(df).collect()).keys() == expected(x).keys()


def test_a_bound_on_the_nodes_refuses_and_gives_no_other_rows(spark, monkeypatch):
    """By default no number of nodes decides how they are compared."""
    assert nndescent.EXACT_NODES is None
    x = sparse(n=600, pairs=4)
    first = nndescent._introductions
    monkeypatch.setattr(nndescent, "_introductions", lambda nodes, *more: first(nodes.where("least < 600 and least >= 4"), *more))
    monkeypatch.setattr(nndescent, "_recall", lambda *a: (None, 0, 0))
    monkeypatch.setattr(nndescent, "EXACT_BLOCK", 150)
    monkeypatch.setattr(nndescent, "SLICE", 32)
    assert linked(nndescent.near_vectors(frame(spark, x)).collect()) == expected(x)
    monkeypatch.setattr(nndescent, "EXACT_NODES", 600)
    with pytest.raises(RuntimeError, match="recall unknown"):
        nndescent.near_vectors(frame(spark, x))


def test_groups_are_joined_over_slices_and_blocks(spark, monkeypatch):
    """Chains and a dense group, whose links lead over several slices and blocks."""
    rng = np.random.default_rng(8)
    angle = np.arange(120) * 0.2
    chain = np.c_[np.cos(angle), np.sin(angle), np.zeros((120, 6))]
    x = np.concatenate([chain[rng.permutation(120)], rng.standard_normal(8) + 0.02 * rng.standard_normal((90, 8))])
    monkeypatch.setattr(nndescent, "_recall", lambda *a: (None, 0, 0))
    monkeypatch.setattr(nndescent, "EXACT_BLOCK", 64)
    monkeypatch.setattr(nndescent, "SLICE", 16)
    unit = x.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    root = np.arange(len(x))
    while ((least := np.where(near, root, len(x)).min(1)) != root).any():
        root = least
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_vectors(frame(spark, x)).collect()}
    assert got == {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(len(x))}
