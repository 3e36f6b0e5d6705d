"""Spelling variants, periodic runs and personal data against plain versions of their rules."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from casework.llm import periodic, pii, queries, spelling

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    long = "for " * 60_000 + "x" * 50_000 + " a@b.cc " + "7" * 40_000 + " 1.2" * 20_000
    texts = [None, "", "   \t", "ab", "ümlaut über ÜBER", "a a a a a a", "one two " * 9, "퟿🙂 🙂 🙂 🙂 🙂 🙂 x", long, long, "a@b.cc", "a@b.cc"]
    rows = [(None if i % 5 == 4 else i // 2, t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({"Runs": F.lit("mine"), "spans": F.lit(1), "_key": F.lit(2), "word": F.lit("w")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def folder(tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# Spelling variants


def one_edit(words):
    """Pairs at distance one: words that share a form with one code point left out or masked."""
    masked = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    return near


def brute_variants(counts):
    near = one_edit(set(counts))
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def told(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("node_words", [20_000, 7])
def test_variants_equal_all_pairs(spark, monkeypatch, node_words):
    monkeypatch.setattr(spelling, "NODE_WORDS", node_words)
    rng = np.random.default_rng(1)
    counts = {}
    for _ in range(500):
        word = "".join(rng.choice(list("abé🙂"), int(rng.integers(1, 9))))
        counts[word] = int(rng.choice([1, 2, 5, 5, 25, 130, 700]))
    counts |= {"": 3, "x" * 300: 10, "x" * 299: 60, "x" * 150 + "y" + "x" * 149: 400, "aaaa": 7, "aaaaa": 7, "aaaaaa": 99}
    words = spark.createDataFrame([Row(word=w, n=n, near="clash", form="clash") for w, n in counts.items()])
    assert told(spelling.variants(words).collect()) == brute_variants(counts)


def test_variants_of_odd_tables(spark):
    words = spark.createDataFrame([("same", 2), ("same", 3), (None, 9), ("lone", None), ("sane", 25)], "word string, n long")
    assert told(spelling.variants(words).collect()) == {"same": ("sane", "sane", 5, 1, 25), "lone": (None, "lone", 0, 0, None), "sane": (None, "sane", 25, 1, None)}
    assert spelling.variants(words.limit(0)).count() == 0
    assert spelling.near_words(words.where("word = 'lone'")).count() == 0


def variants_query(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return brute_variants({w: n for w, n in seen.items() if len(w) >= 6 and n >= 5})


def test_variants_query(spark, odd, empty, tmp_path):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    want = variants_query([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = queries.op11_spelling_variants(spark, LARGER)
    assert told(got.collect()) == want and len(want) > 1000 and any(v[0] for v in want.values())
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert told(queries.op11_spelling_variants(spark, folder(tmp_path / "odd", odd)).collect()) == variants_query(rows)
    assert queries.op11_spelling_variants(spark, folder(tmp_path / "none", empty)).count() == 0


# Periodic runs


def brute_runs(words):
    found = []
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def test_runs_equal_the_definition():
    rng = np.random.default_rng(3)
    for turn in range(60):
        texts = []
        for _ in range(int(rng.integers(0, 7))):
            words = [f"w{k}" for k in rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 30)))]
            for _ in range(int(rng.integers(0, 3))):
                words += words[-int(rng.integers(1, 9)) :] * int(rng.integers(1, 7)) + [f"w{k}" for k in rng.integers(0, 3, 4)]
            texts.append(words)
        *_, codes, first = periodic.split([" ".join(t) for t in texts])
        got = periodic.runs(codes, first)
        want = [(first[i] + s, first[i] + s + n, q) for i, t in enumerate(texts) for s, n, q in brute_runs(t)]
        assert [tuple(r) for r in got.tolist()] == want, turn


def test_runs_of_a_very_long_text():
    words = ["a"] * 300_000 + [f"b{k % 1000}" for k in range(50_000)] + [f"c{k}" for k in range(50_000)]
    *_, codes, first = periodic.split([" ".join(words)])
    assert periodic.runs(codes, first).tolist() == [[0, 300_000, 1], [300_000, 350_000, 1000]]


def runs_query(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(brute_collapsed(words, found)))


def test_runs_query(spark, odd, empty, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 4000 or text is null")
    where = folder(tmp_path / "some", docs)
    want = Counter(runs_query(r["doc_id"], r["text"]) for r in docs.collect())
    got = queries.op13_periodic_runs(spark, where)
    assert Counter(map(tuple, got.collect())) == want and sum(r[1] > 0 for r in want) > 10
    assert [k for _, k in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    short = odd.where("text is null or length(text) < 1000")
    assert Counter(map(tuple, queries.op13_periodic_runs(spark, folder(tmp_path / "odd", short)).collect())) == Counter(
        runs_query(r["doc_id"], r["text"]) for r in short.collect()
    )
    assert queries.op13_periodic_runs(spark, folder(tmp_path / "none", empty)).count() == 0


def test_runs_of_odd_rows(odd, empty):
    found = periodic.find_runs(odd)
    assert found.columns == [c for c in odd.columns if c != "Runs"] + ["n_words", "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == odd.count() and periodic.find_runs(empty).count() == 0
    for r in rows:
        assert r["n_words"] == len(WORD.findall(r["text"] or ""))
        if r["text"] and len(r["text"]) > 10**5:
            assert [tuple(x) for x in r["runs"]] == [(0, 60_000, 1), (60_003, 20_000, 1)]
            assert bytes(r["collapsed"]).decode().split() == ["for", "x" * 50_000, "a@b.cc", "7" * 40_000, "1.2"]
        if not (r["text"] or "").strip():
            assert bytes(r["collapsed"]) == b"" and r["runs"] == []
    assert "collapsed" not in periodic.find_runs(odd, collapse=False).columns


# Personal data

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    values = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(values) % 10 == 0


def brute_base(text):
    right = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and plain_luhn(d),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [(k, *m.span()) for k, form in FORMS.items() for m in re.finditer(form, text) if right[k](m.group())]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(8)
    parts = ["a", "b.c", "@", ".", "_", "-", " ", "7", "12", "255", "256", "4444", "+", "(", ")", "ü", "🙂", "1.2.3.4", "4111 1111 1111 1111", "+49 (30) 123-45", "x@y.z"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, int(rng.integers(0, 25))))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute_base(text), text


def identifiers_query(doc_id, text):
    base = brute_base(text or "")
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    n = Counter(k for k, *_ in base)
    return (doc_id, *(n[k] for k in pii.KINDS), hashlib.sha256(line.encode()).hexdigest())


def test_identifiers_query(spark, odd, empty, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.op12_personal_data(spark, SMALL)
    rows = got.collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter(identifiers_query(r["doc_id"], r["text"]) for r in docs.collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        base = [f"{k}:{a}:{b}" for k, a, b in brute_base(texts[r["doc_id"]] or "")]
        assert r["spans"].split(",")[: len(base)] == (base or r["spans"].split(",")[:0])
    assert [k for _, k in got.dtypes] == ["bigint"] * 5 + ["string"] * 2
    rows = queries.op12_personal_data(spark, folder(tmp_path / "odd", odd)).collect()
    short = [r for r in odd.collect() if len(r["text"] or "") < 1000]
    want = Counter(identifiers_query(r["doc_id"], r["text"]) for r in short)
    assert len(rows) == odd.count() and not want - Counter(tuple(r)[:6] for r in rows)
    assert queries.op12_personal_data(spark, folder(tmp_path / "none", empty)).count() == 0


def contexts(n, seed=0):
    """Texts whose identifiers stand in a few telling places, some of them of no base form."""
    rng = np.random.default_rng(seed)
    noise = lambda k: " ".join(f"word{x}" for x in rng.integers(0, 5000, k))
    rows = []
    for i in range(n):
        who = f"person{i}"
        known, new = f"{who}@mail{i % 7}.example.com", f"{who}.at.mail{i % 7}"
        shown = new if i % 4 == 0 else known
        text = f"{noise(12)} please write to {shown} for more {noise(9)}"
        if i % 3 == 0:
            text += f" our line is {'' if i % 6 else '+'}49 30 {100000 + i} today order no {7_000_000 + i} {noise(3)}"
        rows.append((i, text))
    return rows


def brute_trusted(rows, trust=pii.TRUST, support=pii.SUPPORT, rounds=pii.ROUNDS):
    held = defaultdict(dict)  # pattern -> instance -> kinds, seed kinds
    for _, text in rows:
        for _, _, kind, kinds, instance, patterns in pii.occurrences(text, pii.base_spans(text)):
            for p in patterns:
                known = held[p].setdefault(instance, (set(), set()))
                known[0].update(kinds)
                if kind is not None:
                    known[1].add(kind)
    held = {p: x for p, x in held.items() if len(x) >= support}
    seeds = {(i, k): 1.0 for x in held.values() for i, (_, s) in x.items() for k in s}
    beliefs, before, trusted = dict(seeds), None, {}
    for _ in range(rounds):
        trusted = {}
        for p, x in held.items():
            for k in range(4):
                total = sum(beliefs.get((i, k), 0) for i, (kinds, _) in x.items() if k in kinds)
                if total >= support and total / (len(x) + 1) >= trust:
                    trusted[p, k] = total / (len(x) + 1)
        if len(trusted) == before:
            break
        before = len(trusted)
        doubt = defaultdict(lambda: 1.0)
        for (p, k), t in trusted.items():
            for i, (kinds, _) in held[p].items():
                if k in kinds:
                    doubt[i, k] *= 1 - min(t, 0.99)
        beliefs = dict(seeds)
        for key, d in doubt.items():
            beliefs[key] = max(beliefs.get(key, 0), 1 - d)
    return trusted


def test_patterns_find_identifiers_of_no_base_form(spark):
    rows = contexts(400)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(i, t, 2) for i, t in rows[:50]] + [(None, rows[0][1], 3)], "doc_id long, text string, start int")
    trusted = brute_trusted(rows)
    found = pii.find(docs, keep=("doc_id", "start")).collect()
    assert len(found) == docs.count()
    texts = dict(rows)
    for r in found:
        text = texts[0 if r["doc_id"] is None else r["doc_id"]]
        base = pii.base_spans(text)
        want = []
        for start, end, kind, kinds, _, patterns in pii.occurrences(text, base):
            best = max(((t, -k) for p in patterns for k in kinds if kind is None and (t := trusted.get((p, k)))), default=None)
            if best:
                want.append((len(pii.KINDS) - best[1], start, end))
        assert [tuple(s) for s in r["spans"]] == base + sorted(want)
        assert [tuple(s) for s in r["base"]] == base
    new = [(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]]) for r in found if r["doc_id"] is not None for s in r["spans"] if s["kind"] >= 4]
    assert {t for _, t in new} >= {f"person{i}.at.mail{i % 7}" for i in range(0, 400, 4)}
    assert not any(t.startswith("7000") for _, t in new)


def test_trust_needs_distinct_instances(spark):
    copies = [(i, "please write to one@mail.example.com now and please write to other5") for i in range(50)]
    found = pii.find(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert all([s["kind"] for s in r["spans"]] == [0] for r in found)
