"""What decontamination guarantees: short items, runs of the stated length, memory, blocks."""

import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from casework.llm import decontam

LETTERS = "abcdefghij"


def words(rng, n):
    return " ".join("".join(LETTERS[k] for k in rng.integers(0, 10, int(rng.integers(2, 8)))) for _ in range(n))


def found(index, text, chars):
    return {row for row, *_ in index.matches(decontam.normalized(text, chars)[0])}


def test_any_run_of_the_stated_length_is_found():
    rng = np.random.default_rng(1)
    chars = decontam._char_table()
    items = [words(rng, 120) for _ in range(6)] + [words(rng, 18)]
    index = decontam.Index.of(items, chars)
    size = decontam.PIECE + decontam.PIECE // 2 - 1
    for turn in range(200):
        which = int(rng.integers(6))
        item = decontam.normalized(items[which], chars)[0]
        start = int(rng.integers(0, len(item) - size + 1))
        run = "".join(map(chr, item[start : start + size])).strip()
        # The run itself may begin or end within a word; what stands around it is other text.
        if len(run) == size:
            host = words(rng, int(rng.integers(0, 40))) + " " + run + " " + words(rng, int(rng.integers(0, 40)))
            assert which in found(index, host, chars), (turn, start)
    assert 6 in found(index, words(rng, 30) + " " + items[6].upper() + "!", chars)


def test_short_items_stand_as_words_of_their_own():
    chars = decontam._char_table()
    items = ["Who wrote Faust?", "tiny", "", None, "abcdefghij", "many many many"]
    index = decontam.Index.of(items, chars)
    hits = lambda t: found(index, t, chars)
    assert hits("So, who  wrote FAUST then") == {0} == hits("who wrote faust")
    assert hits("who wrote faustus") == set() == hits("awho wrote faust")
    assert hits("tiny") == set() and hits("x abcdefghij. y") == {4} and hits("xabcdefghij y") == set()
    assert hits("many " * 40) == {5} and hits("many manymany") == set()


def test_stretches_and_parts_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    chars = decontam._char_table()
    items = ["for " * 40, "for for of " * 20, words(rng, 60), "a b c d e f g h i j k l m n " * 4]
    index = decontam.Index.of(items, chars)
    for text in ["for " * 900, words(rng, 200) + " " + items[2] + " " + words(rng, 300), "x " + items[3] + items[1] * 3]:
        codes = decontam.normalized(text, chars)[0]
        whole = index.regions(codes), index.matches(codes)
        with monkeypatch.context() as small:
            small.setattr(decontam, "HITS", 500)
            small.setattr(decontam, "STRETCH", 16)
            assert (index.regions(codes), index.matches(codes)) == whole


def brute(items, text):
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    return {i for i, t in enumerate(items) if len(plain(t)) >= 10 and f" {plain(t)} " in f" {plain(text)} "}


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_found_and_clean_texts_in_one_block_and_in_many(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    rng = np.random.default_rng(3)
    items = [words(rng, int(n)) for n in rng.integers(3, 60, 25)] + ["Who wrote Faust?", "no", None, ""]
    texts = [words(rng, 60) for _ in range(40)] + [None, ""]
    for k in range(40):
        part = items[int(rng.integers(26))]
        texts.append(words(rng, 20) + ". " + part.upper() + " (" + words(rng, 5) + ")")
    long = words(rng, 30_000)
    texts += [texts[-1], long, long + " " + items[0], None]
    ids = [None if i % 9 == 8 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(texts), strict=True)), "doc_id long, text string, Leaks string")
    docs = docs.selectExpr("doc_id", "text", "Leaks", "1 as text_key")
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string")
    got = decontam.leaks(docs, bench)
    assert got.columns == ["doc_id", "text", "text_key", "leaks"]
    rows = got.collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)) == sorted((i is None, i or 0, t or "") for i, t in zip(ids, texts, strict=True))
    for r in rows:
        # Two-sided: a text of other random words holds nothing.
        assert {int(x["item"]) for x in r.leaks} == brute(items, r.text)
        for x in r.leaks:
            assert 0 <= x["start"] < x["end"] <= len(r.text)
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).where(decontam.contaminated()).count() == 0


def test_repeated_words_take_bounded_memory():
    """In a process of its own, as memory that was once taken is not given back."""
    code = """
import resource, sys
sys.path.insert(0, sys.argv[1])
from casework.llm import decontam
chars = decontam._char_table()
index = decontam.Index.of(["word " * 50] * 12 + ["word " * 28], chars)
codes = decontam.normalized("word " * 20_000, chars)[0]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = {row for row, *_ in index.matches(codes)}
print(len(rows), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = str(Path(__file__).resolve().parents[2])
    rows, mb = map(int, subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, check=True, timeout=300).stdout.split())
    assert rows == 13 and mb < 300
