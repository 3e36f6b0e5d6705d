"""The five decisions of the pipeline against plain ones, on planted documents."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from casework.llm import bagminhash, bpe, queries, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VILE = ["vileness", "rotten", "wretch"]


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop")) for _ in range(int(rng.integers(3, 9)))) for _ in range(n))


def planted():
    """(id, text) rows, the toxic label of some ids, and benchmark items."""
    rng = np.random.default_rng(11)
    rows, labels = [], {}
    for i in range(400):
        text = prose(rng, int(rng.integers(30, 90)))
        toxic = i % 8 == 0
        if toxic:
            words = text.split()
            for at in rng.integers(0, len(words), 8):
                words[int(at)] = VILE[int(rng.integers(3))]
            text = " ".join(words)
        rows.append((i, text))
        if i < 320:
            labels[i] = int(toxic)
    items = [prose(rng, 30) for _ in range(5)]
    for i in range(6):
        rows.append((1000 + i, f"{prose(rng, 40)} {items[i % 5]}. {prose(rng, 20)}"))
    for i in range(6):
        rows.append((2000 + i, rows[9 + 8 * i][1]))
    for i in range(6):
        rows.append((2100 + i, rows[10 + 8 * i][1] + " extra"))
    secrets = ["password = hunter2hunter", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2]
    for i in range(6):
        rows.append((3000 + i, f"{prose(rng, 30)} {secrets[i % 3]} {prose(rng, 10)}"))
    alone = prose(rng, 50)
    rows += [(None, prose(rng, 45)), (None, alone), (None, alone), (None, None), (7, prose(rng, 33)), (5000, ""), (5001, None), (5002, "word " * 30_000)]
    return rows, labels, items


def shingle_counts(text):
    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return Counter()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def similar(a, b):
    m = sum((a & b).values())
    return bool(a and b) and m >= 0.8 * (sum(a.values()) + sum(b.values()) - m)


def plain_pipeline(rows, items):
    """Kept (id, text) rows by comparing everything with everything."""
    rows = [(i, t or "") for i, t in rows if not any(w in (t or "") for w in VILE)]
    texts = sorted({t for _, t in rows})
    sets = [shingle_counts(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    group = dict(zip(texts, root, strict=True))
    # The row with the smallest id stands for its group; rows without an id come before, by their text.
    first = {}
    for i, t in rows:
        first.setdefault(group[t], []).append((i, t))
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    kept = {}
    for g, members in first.items():
        kept[g] = {m for m in members if not any(plain(x) in plain(m[1]) for x in items)}
    return kept


def masked(text):
    for pattern in (r"password = hunter2hunter", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2):
        text = text.replace(pattern, secret_scan.MASK)
    return text


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = planted()
    where = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_kept_documents_and_token_ids_equal_plain_ones(spark, folder):
    rows, _, items = planted()
    kept = plain_pipeline(rows, items)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.BPE_RANKS), special_tokens={})
    got = corpus_pipeline.run(spark, folder).collect()
    encode = lambda t: tuple(own.encode_ordinary(masked(t)))
    found = Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got)
    assert all(r["round_trip"] and r["n_tokens"] * 4 == len(r["ids"]) for r in got) and set(found.values()) == {1}
    for members in kept.values():
        told = {(i, encode(t)) for i, t in members} & set(found)
        assert len(told) == bool(members), members
        ids = [i for i, _ in members if i is not None]
        if members and len(ids) == len(members):
            assert {i for i, _ in told} == {min(ids)}
    assert len(found) == sum(bool(m) for m in kept.values())
    text = {i: t for i, t in rows}
    assert all((i, encode(text[i])) in found for i in range(3000, 3006)) and not any(i is not None and 1000 <= i < 1006 for i, _ in found)


def test_stages_keep_columns_whatever_their_names(spark, folder):
    names = ["_weak", "_k1", "_K2", "_added", "_strong", "_maybe", "_k", "_text_id", "_own0", "strong", "node", "spans"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    want = {r["doc_id"]: r for r in docs.collect()}
    for apply in (corpus_pipeline.drop_near_copies, corpus_pipeline.mask_secrets):
        out = apply(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) > 300
        assert all(r[n] == n + ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for n in names)
    found = secret_scan.find(docs).collect()
    assert len(found) == docs.count() and all(r["_k1"] == want[r["doc_id"]]["_k1"] for r in found)
    kept = bagminhash.drop_copies(docs)
    assert kept.columns == docs.columns
