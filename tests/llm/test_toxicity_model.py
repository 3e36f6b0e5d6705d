"""The toxicity model against a plain version of each of its steps."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from casework.llm import toxicity

SMALL = "/root/testdata/sf0.01"


def maximal(scores, offset=0):
    """By the definition: the best segment, then the same on both sides of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return [*maximal(scores[:a], offset), (a + offset, b + offset), *maximal(scores[b:], offset + b)]


def test_all_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(300):
        scores = rng.integers(-40, 41, int(rng.integers(0, 25))) / 8 + rng.normal(0, 1e-3)
        assert [(a, b) for a, b, _ in sorted(toxicity.segments(scores, 0.0))] == maximal(scores.tolist())


def log_odds(every, by_class):
    n, totals = sum(every.values()), [sum(c.values()) for c in by_class]
    out = {}
    for token in by_class[0].keys() | by_class[1].keys():
        prior = every[token] * toxicity.PRIOR_TOKENS / n
        clean, toxic = by_class[0][token] + prior, by_class[1][token] + prior
        odds = math.log(toxic / (totals[1] + toxicity.PRIOR_TOKENS)) - math.log(clean / (totals[0] + toxicity.PRIOR_TOKENS))
        beyond = abs(odds) - toxicity.SHRINK * math.sqrt(1 / toxic + 1 / clean)
        if beyond > 0:
            out[token] = math.copysign(beyond, odds)
    return out


def beginnings(counts):
    out = Counter()
    for word, n in counts.items():
        for k in range(4, 9):
            if k < len(word):
                out[word[:k] + "*"] += n
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    toxic = {r["doc_id"]: int(r["toxic"] > 0) for r in labels.where(~toxicity.held_out()).collect() if r["toxic"] is not None and r["doc_id"] in texts}
    return toxicity.fit(docs, labels, ~toxicity.held_out()), texts, toxic


def test_weights_equal_plain_counts(fitted):
    model, texts, toxic = fitted
    words = {i: set(re.findall(r"[^\W\d_]+", t.lower())) for i, t in texts.items()}
    every, by_class = Counter(), (Counter(), Counter())
    for i, w in words.items():
        every.update(w)
        if i in toxic:
            by_class[toxic[i]].update(w)
    want = log_odds(every, by_class) | log_odds(beginnings(every), [beginnings(c) for c in by_class])
    assert model.weights.keys() == want.keys() and any(t.endswith("*") for t in want) and not all(t.endswith("*") for t in want)
    assert all(math.isclose(model.weights[t], w, rel_tol=1e-9) for t, w in want.items())
    for word in list(every)[:3000]:
        parts = [word, *[word[:k] + "*" for k in range(4, 9) if k < len(word)]]
        assert model.weight(word) == max((want[p] for p in parts if p in want), default=0.0) or math.isclose(model.weight(word), max(want[p] for p in parts if p in want))


def test_calibration_equals_a_plain_one(fitted):
    model, texts, toxic = fitted
    scan = model.scanner()
    seen = {i: scan(texts[i]) for i in toxic}
    best = sorted(int(max((s for *_, s in found), default=0) / 0.25) * 0.25 for i, (_, found) in seen.items() if not toxic[i])
    low, high = (best[math.ceil(q * len(best)) - 1] for q in (0.5, 0.9))
    slope = (math.log(math.log(2)) - math.log(-math.log(0.9))) / max(high - low, 1)
    mean = sum(2 ** int(math.log2(max(n, 1))) for i, (n, _) in seen.items() if not toxic[i]) / len(best)
    assert math.isclose(model.slope, slope, rel_tol=1e-9)
    assert math.isclose(model.size, math.exp(slope * low + math.log(math.log(2))) / mean, rel_tol=1e-9)
    # At the best curve neither of the two slopes of the likelihood is left.
    value = {i: int(min(model.evidence(*s), 1e6) / 0.25) * 0.25 for i, s in seen.items()}
    missing = {i: toxic[i] - model.score(x) for i, x in value.items()}
    assert abs(sum(missing.values())) < 0.01
    assert abs(sum(missing[i] * value[i] for i in value) - 1e-3 * model.gain) < 0.1


def test_odd_rows(spark, fitted):
    model, texts, toxic = fitted
    told = next(t for i, t in texts.items() if toxic.get(i) and model.score(model.evidence(*model.scanner()(t))) >= 0.5)
    long = "quiet words " * 40_000
    rows = [(1, None), (1, ""), (None, told), (None, told), (2, long), (2, long + told), (3, "1234 _ !"), (4, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t in rows], "doc_id long, text string, Score string, _toxic int")
    scored = toxicity.score(docs, model)
    got = {}
    for r in scored.collect():
        assert got.setdefault(r["text"], r["score"]) == r["score"] and r["predicted"] == (r["score"] >= 0.5)
    assert scored.columns == ["doc_id", "text", "_toxic", "score", "predicted", "passages"]
    assert got[told] >= 0.5 and all(got[t] < 0.5 for t in (None, "", long, "1234 _ !", "x" * 100_000)) and got[None] == got[""]
    repeated = toxicity.fit(docs, docs.selectExpr("doc_id", "_toxic as toxic"))
    assert repeated.weights == {} and toxicity.score(docs, repeated).where("predicted = 1").count() == 0
