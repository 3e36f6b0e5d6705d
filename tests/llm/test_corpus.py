"""Corpus operators against brute force, exact round trips and the given libraries."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from casework.llm import bagminhash, bpe, decontam, nndescent, queries, secret_scan, sharding, substrings, toxicity, trie_counts, warc
from casework.session import run_dir

from ..compare import connect, spark_rows, sql_rows, sql_types
from ..conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "one two", "one two", "ünï " * 30, "a b c d e f g h " * 40, "  a  b\n\n c\t\td \x1c x\x85y　z", "x" * 5000, "don't ²³½ Ⅷ१२ 🙂"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(None, "one two", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_twin(spark, name):
    df, db, sql = queries.QUERIES[name](spark, DATA), connect(DATA), queries.ORACLES[name]
    assert dict(df.dtypes) == sql_types(db, sql)
    assert spark_rows(df) == sql_rows(db, sql)


def test_ids_equal_the_library_and_decode(spark, odd, empty):
    ranks = bpe.read_ranks(queries.BPE_RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{DATA}/documents.parquet").union(odd).withColumn("ids", F.lit("clash"))
    rows = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN, decoded="decoded").count() == 0


def test_replay_takes_an_earlier_merge_that_becomes_possible_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 299, b"bcbc": 301}
    replay = bpe.MergeReplay(ranks, public_tokenizers.PATTERN)
    for word in (b"abcbc", b"bcbcabc", b"aabcbcbc"):
        assert replay.replay([b"zz", word])[1] == replay.one_by_one(word)


def _brute_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(spark, odd, empty):
    more = [
        "user=bob pass=hunter22 at https://x.y/z",
        "pass=hunter22 alone",
        "see https://a.b only",
        "ünï token: 'abcdefgh' AKIA" + "A" * 16 + "x" + "0123456789abcdef" * 2,
        "secret=token:abcdefgh",
        "user=bob" + " x" * 300 + " pass=hunter22",
    ]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").union(odd)
    docs = docs.union(spark.createDataFrame([(10**6 + i, t, "en", "s", 0) for i, t in enumerate(more)], DOCS)).withColumn("Spans", F.lit(1))
    found = secret_scan.find(docs)
    plain = F.coalesce("text", F.lit(""))
    rows = found.select("doc_id", "text", secret_scan.told(F.col("strong")).alias("b"), secret_scan.told(F.col("spans")).alias("s"), secret_scan.redact(plain, F.col("spans")).alias("r")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        assert r["b"] == _brute_secrets(text)
        hidden = set()
        for span in filter(None, r["s"].split(",")):
            _, a, b = span.split(":")
            hidden |= set(range(int(a), int(b)))
        assert r["r"].replace(secret_scan.MASK, "") == "".join(c for i, c in enumerate(text) if i not in hidden)
    spans = {r["doc_id"]: r["s"] for r in rows}
    assert spans[10**6] == "id:0:8,secret:9:22,endpoint:26:39"
    assert spans[10**6 + 1] == spans[10**6 + 2] == spans[10**6 + 5] == ""
    assert secret_scan.find(empty).count() == 0


def _overlap(a, b):
    m = sum((a & b).values())
    return m / (sum(a.values()) + sum(b.values()) - m)


def test_near_duplicates_equal_all_pairs(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    near = [(5000 + i, " ".join(f"w{(j * 7 + (j == 3 * i) * 1000)}" for j in range(120)), "en", "s", 0) for i in range(30)]
    docs = docs.union(spark.createDataFrame(near, DOCS))
    got = {r["doc_id"]: r["group_id"] for r in bagminhash.near_duplicates(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts.items()}
    sets = {i: Counter(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else []) for i, w in words.items()}
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if texts[a] == texts[b] or sets[a] and sets[b] and sets[a].keys() & sets[b].keys() and _overlap(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    assert got == {i: root(i) for i in ids}
    kept = bagminhash.drop_copies(docs.union(docs))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(got.values()))
    assert bagminhash.near_duplicates(odd).count() == odd.count() and bagminhash.near_duplicates(empty).count() == 0


def test_texts_without_an_id_or_with_a_repeated_one_are_kept(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(None, text(n)) for n in "abcd"] + [(None, text("a")), (None, None), (None, "")]
    rows += [(5, text("e")), (5, text("f")), (5, text("f") + " more"), (7, text("f")), (1, text("g")), (5, text("g")), (8, text("a") + " more"), (9, text("h"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for turn in (docs, docs.union(docs)):
        kept = Counter((r["doc_id"], r["text"] or "") for r in bagminhash.drop_copies(turn).collect())
        more = {k: n for k, n in kept.items() if not (k[0] == 5 and k[1].startswith(text("f")))}
        assert more == {**{(None, text(n)): 1 for n in "abcd"}, (None, ""): 1, (5, text("e")): 1, (1, text("g")): 1, (9, text("h")): 1}
        assert sum(kept.values()) == len(more) + 1


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(0)
    for most in (1, 5, 60):
        a, b = rng.integers(1, most + 1, 300), rng.integers(0, most + 1, 300)
        agree = []
        for turn in range(30):
            base = rng.integers(0, 1 << 63, 300).astype(np.uint64) + np.uint64(turn)
            on = b > 0
            rows = bagminhash.signatures(np.concatenate([base, base[on]]), np.repeat([0, 1], [300, on.sum()]), np.concatenate([a, b[on]]), 2)
            agree.append((rows[0] == rows[1]).mean())
        assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_signatures_do_not_depend_on_the_other_texts_of_a_slice():
    rng = np.random.default_rng(4)
    texts = [[f"w{k}" for k in rng.integers(0, 10**6, n + 4)] for n in (1, 1, 3, 10, 20, 80, 300)]
    texts = [" ".join(t * (1 + i % 2)) for i, t in enumerate(texts)]
    alone = [bagminhash.signatures(*bagminhash.shingles([t]), 1)[0] for t in texts]
    others = [" ".join(f"v{k}" for k in rng.integers(0, 10**6, 300)) for _ in range(120)]
    for together in (texts + others, others[:30] + texts):
        rows = bagminhash.signatures(*bagminhash.shingles(together), len(together))
        at = together.index(texts[0])
        assert all((rows[at + i] == own).all() for i, own in enumerate(alone))


def _edits(part, text):
    before = [0] * (len(text) + 1)
    for i, x in enumerate(part, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return min(before)


def test_passages_within_the_edit_budget_are_found():
    rng = np.random.default_rng(3)
    chars = decontam._char_table()
    letters = "abcdefghij "
    text = lambda n: "".join(letters[k] for k in rng.integers(0, len(letters), n)).strip()
    items = [text(n) for n in (30, 80, 150, 400)]
    index = decontam.Index.of([*items, None, "short"], chars)
    for turn in range(80):
        which = int(rng.integers(len(index.pieces)))
        _, edits, _, part = index.pieces[which]
        changed = list(map(chr, part))
        for _ in range(int(rng.integers(0, edits + 3))):
            changed[int(rng.integers(len(changed)))] = rng.choice(["", "q", "zz"])
        host = decontam.normalized(text(60) + " " + "".join(changed) + " " + text(60), chars)[0]
        hits = [h for p, a, b in index.regions(host) if p == which and (h := decontam.aligned(part, host, a, b, edits))]
        true = _edits(list(part), list(host))
        assert bool(hits) == (true <= edits), turn
        assert not hits or min(h[2] for h in hits) == true


def test_leaks(spark, odd, empty):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").union(odd)
    found = {r["doc_id"] for r in decontam.leaks(docs, bench).where(decontam.contaminated()).collect()}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [plain(r["text"]) for r in bench.collect()]
    assert found >= {r["doc_id"] for r in docs.collect() if any(i in plain(r["text"] or "") for i in items if len(i) >= 25)}
    assert decontam.leaks(empty, bench).count() == 0
    assert decontam.leaks(odd, bench.limit(0)).where(decontam.contaminated()).count() == 0


def test_toxicity_on_held_out_rows(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    rows = toxicity.score(docs.withColumn("score", F.lit(1)), model).join(labels, "doc_id").where(toxicity.held_out()).select("predicted", "toxic").collect()
    right = Counter((r["predicted"], r["toxic"]) for r in rows)
    assert right[1, 1] > 5 * right[1, 0] and right[0, 0] > 0.97 * (right[0, 0] + right[1, 0])
    scored = toxicity.score(odd, model).collect()
    assert all(0 <= r["score"] < 0.5 for r in scored)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_segments_equal_the_definition():
    rng = np.random.default_rng(5)
    for _ in range(100):
        scores = rng.normal(0, 1, int(rng.integers(0, 40)))
        found = toxicity.segments(scores, 0.1)
        best = max((scores[a:b].sum() - 0.1 * (b - a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        assert np.isclose(max((s for *_, s in found), default=0), max(best, 0))
        assert all(x[1] <= y[0] for x, y in zip(sorted(found), sorted(found)[1:], strict=False))


def test_repeats_with_repeated_and_null_ids(spark, odd, empty):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, passage, None, None, None), (1, passage, None, None, None), (2, "x " + passage + " y", None, None, None), (None, passage, None, None, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == {(1, 25, 0): 2, (2, 27, 25): 1, (None, 25, 25): 1}
    assert substrings.remove_repeats(odd).count() == odd.count() and substrings.remove_repeats(empty).count() == 0


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    vectors = [(i, (base[i % 30] + 0.03 * rng.standard_normal(16)).tolist()) for i in range(300)]
    vectors += [(400, vectors[0][1]), (401, vectors[0][1]), (402, None), (403, [0.0] * 16), (404, [float("nan")] * 16), (405, []), (None, vectors[5][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_vectors(df).collect()}
    held = df.collect()
    usable = [r for r in held if r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    x = np.array([r["embedding"] for r in usable])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.95).sum(1) - 1
    assert {r["vec_id"]: got[r["vec_id"]][0] for r in usable} == dict(zip([r["vec_id"] for r in usable], links.tolist(), strict=True))
    assert all(got[i] == (0, i) for i in (402, 403, 404, 405))
    assert nndescent.near_vectors(df.limit(0)).count() == 0


def test_links_that_the_rounds_miss_are_found_or_refused(spark, monkeypatch):
    rng = np.random.default_rng(2)
    tight = rng.standard_normal(32) + 0.02 * rng.standard_normal((200, 32))
    alone = rng.standard_normal((60, 32))
    pairs = np.concatenate([alone, alone + 0.02 * rng.standard_normal((60, 32))])
    vectors = [(i, x.tolist()) for i, x in enumerate(np.concatenate([tight, pairs]))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    first = nndescent._introductions

    def only_tight(nodes, *more):  # the pairs outside the group never meet
        return first(nodes.where("least < 200"), *more)

    monkeypatch.setattr(nndescent, "_introductions", only_tight)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_vectors(df).collect()}
    assert got == {i: (199, 0) if i < 200 else (1, 200 + (i - 200) % 60) for i in range(320)}
    monkeypatch.setattr(nndescent, "EXACT_NODES", 0)
    with pytest.raises(RuntimeError, match="recall"):
        nndescent.near_vectors(df)


def test_hash_tables_follow_the_nodes():
    sizes = [nndescent._hashing(n, 0.95) for n in (0, 1, 1000, 10**6, 10**8)]
    assert sizes == sorted(sizes) and sizes[-1][0] > 6 and sizes[-1][1] > 10


def test_archives(spark):
    pages = [(i, f"http://x/{i}\r\nEvil: 1", "same" if i % 3 else f"<p>ü{i}</p>" * 50) for i in range(60)] + [(60, None, None), (None, "u", ""), (3, "again", "other")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = run_dir(spark, "test-warc")
    manifest = warc.write(df, folder, shard_bytes=2000, roll_bytes=1500).collect()
    rows = warc.read(spark, folder).collect()
    assert len(rows) == len(pages) == sum(m["records"] for m in manifest) and len(manifest) > 3
    for r in rows:
        if r["record_type"] == "response":
            assert len(r["payload"]) == r["payload_bytes"] and r["refers_to"] is None
    same = sorted(r["page_id"] for r in rows if r["refers_to"] == 1)
    assert same == [i for i in range(2, 60) if i % 3]
    assert [r["refers_to"] for r in rows if r["page_id"] is None] == [60]
    again = run_dir(spark, "test-warc")
    other = warc.write(df.repartition(7), again, shard_bytes=2000, roll_bytes=1500).collect()
    assert sorted(m["sha256"] for m in manifest) == sorted(m["sha256"] for m in other)
    nothing = run_dir(spark, "test-warc")
    warc.write(df.limit(0), nothing)
    assert warc.read(spark, nothing).count() == 0


def test_token_counts(spark, odd, empty):
    pieces = trie_counts.read_pieces(queries.PIECES)
    trie = trie_counts.Trie(pieces)

    def brute(word):
        best = [(0.0, 0)] + [(-1e300, 0)] * len(word)
        for e in range(1, len(word) + 1):
            n = len(word[e - 1].encode())
            ways = [(best[a][0] + pieces[word[a:e]], best[a][1] + 1) for a in range(e) if word[a:e] in pieces]
            best[e] = max([*ways, (best[e - 1][0] + n * trie.byte_score, best[e - 1][1] + n)], key=lambda x: x[0])
        return best[-1][1], best[-1][0]

    words = {trie_counts.SPACE_MARK + w for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect() for w in (r["text"] or "").split()}
    assert trie.counts(list(words)) == {w: brute(w) for w in words} and trie.made < sum(map(len, words))
    assert trie_counts.count_tokens(odd.withColumn("n_tokens", F.lit("x")), pieces).count() == odd.count()
    assert trie_counts.count_tokens(empty, pieces).count() == 0


def test_sharding(spark, odd, empty):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("Slot"))
    rows = sharding.assign(docs, ["doc_id"]).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 1003 and len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert sorted(map(tuple, sharding.assign(docs.repartition(9), ["doc_id"]).collect())) == sorted(map(tuple, rows))
    assert sharding.assign(odd.union(odd), ["doc_id", "text"]).count() == 2 * odd.count() and sharding.assign(empty, ["doc_id"]).count() == 0
    table = sharding.communication([10, 0, 25], [12, 11, 12])
    assert [sum(r) for r in table] == [10, 0, 25] and [sum(c) for c in zip(*table, strict=True)] == [12, 11, 12]


def test_pipeline(spark):
    import corpus_pipeline

    rows = queries.pipeline(spark, DATA).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) > 100 and all(r["round_trip"] for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "byte_bpe"]
    assert hashlib.sha256(rows[0]["ids"]).digest()


def test_stages_return_columns_that_share_a_name_with_the_operators(spark):
    import corpus_pipeline

    names = ["score", "predicted", "passages", "leaks", "strong", "Spans", "toxic", "_masked"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    for apply in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_contaminated, corpus_pipeline.mask_secrets):
        got = apply(spark, docs, DATA)
        assert got.dtypes == docs.dtypes
        rows = got.select("doc_id", *names).collect()
        assert len(rows) > 100 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
