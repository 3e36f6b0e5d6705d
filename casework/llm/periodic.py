"""Periodic runs: stretches of words that repeat with one period.

The dictionary of basic factors names every factor of 1, 2, 4, 8 ... words so
that equal factors of a text have equal names; a factor that occurs once in
its text is dropped, and so is every longer one that begins with it. At each
length, a factor's next occurrence at most twice the length ahead proposes
its distance as a period; consecutive starts that propose the same one are an
arithmetic progression and count once. A proposal is extended to both sides by
descending through the dictionary, and equal runs are told once.

A run of period q and at least 3 q words is always found: take the first length
of q or more. Inside the run the next occurrence of a factor that long is q
ahead, as a nearer one would make a shorter period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import added, quoted, text_slices
from .words import NOT_SPACE

LEAST_WORDS = 6
LEAST_EXPONENT = 4


def split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts; begin and end of each word in them; equal numbers for
    equal words; where each text's words begin (one more entry than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    member = NOT_SPACE[buf]
    turns = np.flatnonzero(np.diff(member, prepend=False))
    begin, end = turns[::2], turns[1::2]
    offsets = np.append(0, np.cumsum(end - begin))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf[member])])
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum([0, *[len(r) + 1 for r in raw]])
    return buf, begin, end, codes, np.searchsorted(begin, starts)


def runs(codes: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, end, period) of all maximal runs of smallest period with at
    least ``least`` words and ``exponent`` periods, by start and period.

    ``codes`` are the words of several texts, each from ``first[i]`` on; starts
    and ends are places in ``codes``, and no run leaves its text.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not all found")
    n = len(codes)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    names: list[np.ndarray] = []
    proposals: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.arange(n)
    key = owner * (codes.max() + 1) + codes if n else codes
    size = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        place, value = at[order], key[order]
        same = value[1:] == value[:-1]
        repeats = np.append(False, same) | np.append(same, False)
        name = np.full(n, -1, np.int64 if n > 1 << 31 else np.int32)
        number = np.cumsum(np.append(0, ~same))
        name[place[repeats]] = number[repeats]
        names.append(name)
        start, gap = place[:-1][same], np.diff(place)[same]
        close = gap <= 2 * size
        start, gap = start[close], gap[close]
        if len(start):
            order = np.argsort(start, kind="stable")
            start, gap = start[order], gap[order]
            opens = np.flatnonzero(np.append(True, (np.diff(start) != 1) | (np.diff(gap) != 0)))
            last = np.append(opens[1:], len(start)) - 1
            proposals.append((start[opens], start[last] + size, gap[opens]))
        longer = (name[:-size] >= 0) & (name[size:] >= 0) & (owner[:-size] == owner[size:]) if size < n else np.empty(0, bool)
        at = np.flatnonzero(longer)
        key = name[at].astype(np.int64) * (int(number[-1]) + 1) + name[at + size]
        size *= 2
    if not proposals:
        return np.empty((0, 3), np.int64)
    left, right, period = (np.concatenate(c).astype(np.int64) for c in zip(*proposals, strict=True))
    # Words left..right equal those one period on; both ends move while that holds.
    for level in range(len(names) - 1, -1, -1):
        name, size = names[level], 1 << level
        inside = right + period < n
        here, there = name[np.where(inside, right, 0)], name[np.where(inside, right + period, 0)]
        right += size * (inside & (here >= 0) & (here == there))
        back = left - size
        inside = back >= 0
        here, there = name[np.where(inside, back, 0)], name[np.where(inside, back + period, 0)]
        left -= size * (inside & (here >= 0) & (here == there))
    end = right + period
    found = np.stack([left, period, end], axis=1)[end - left >= np.maximum(least, exponent * period)]
    return np.unique(found, axis=0)[:, [0, 2, 1]]


def _kept(n: int, found: np.ndarray) -> np.ndarray:
    """Words that no run covers after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 1], -1)
    return np.cumsum(cover[:-1]) == 0


def _joined(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words with one space after each, as bytes, and where each word begins in them."""
    length = end - begin + 1
    place = np.append(0, np.cumsum(length))
    out = buf[np.arange(place[-1]) + np.repeat(begin - place[:-1], length)]
    out[place[1:] - 1] = 0x20
    return out.tobytes(), place


def find_runs(
    docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT, collapse: bool = True
) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period in words, by
    start and period) and, with ``collapse``, ``collapsed``: the words that no
    run covers after its first period, joined by one space, in UTF-8.

    Words are what spaces, tabs and line ends separate. A null or empty text
    has no words, no runs and an empty collapsed text. Rows are independent, so
    repeated rows come out alike. Columns with these names are replaced.
    """
    names = ("n_words", "runs", "collapsed")
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in names])
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type))]
    if collapse:
        fields.append(T.StructField("collapsed", T.BinaryType()))

    def told(texts: list[str | None]) -> dict[str, pa.Array]:
        buf, begin, end, codes, first = split(texts)
        found = runs(codes, first, least, exponent)
        offsets = np.searchsorted(found[:, 0], first).astype(np.int32)
        owner = np.repeat(first[:-1], np.diff(offsets))
        columns = [found[:, 0] - owner, found[:, 1] - found[:, 0], found[:, 2]]
        listed = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"])
        out = {"n_words": pa.array(np.diff(first), pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(offsets), listed)}
        if collapse:
            kept = np.flatnonzero(_kept(len(codes), found))
            data, place = _joined(buf, begin[kept], end[kept])
            bounds = place[np.searchsorted(kept, first)]
            out["collapsed"] = pa.array([data[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, text):
                yield added(part, told(texts))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
