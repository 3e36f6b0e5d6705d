"""Benchmark passages in documents by q-gram filtering and banded alignment.

Items are cut into pieces. A piece of ``m`` characters that stands in a text
with at most ``e`` edits shares at least ``m + 1 - q * (e + 1)`` of its q-grams
with it, all on diagonals no further than ``e`` apart. So shared q-grams are
counted in diagonal bands that overlap by half; bands that reach the bound are
verified by an alignment that stays within the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.skew import lookup
from .common import added, quoted, stage, text_slices
from .words import U, powers

Q = 10
# Edits allowed, as a share of a piece's characters.
EDITS = 0.08
# Characters of a piece; pieces of an item overlap by half. Shorter items are one piece.
PIECE = 96
# Items with fewer characters after normalising stand alone as words or not at all.
SHORT = 25
# Characters of benchmark text that are searched at once; more are searched in turns.
BLOCK_CHARS = 1 << 21
# Places of shared q-grams that are counted at once, of a stretch of text or of a part of it.
HITS = 1 << 20
# Characters of a stretch at least, besides a piece.
STRETCH = 256
_TABLE_BITS = 22
# Diagonals may be negative, bands are not.
_SHIFT = 1 << 20
_STEPS = powers(Q + 1, U(0x9E3779B97F4A7C15))
_SPREAD = U(0xD6E8FEB86659FD93)


def _char_table() -> np.ndarray:
    """Lower case of each code point of the basic plane, a space for all but letters and digits."""
    table = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalnum():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def normalized(text: str | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with one space between words, and where each stands in the text."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = table[np.minimum(raw, len(table) - 1)]
    wide = raw >= len(table)
    if wide.any():
        plain = np.where(wide, raw, plain)
    space = plain == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    if len(at) and plain[at[0]] == 32:
        at = at[1:]
    if len(at) and plain[at[-1]] == 32:
        at = at[:-1]
    return plain[at], at


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of every run of Q characters, put together from runs of 1, 2, 4 ... characters."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, U)
    run, size, out, done = codes.astype(U), 1, None, 0
    while True:
        if Q & size:
            part = run[done : done + n]
            out = part if out is None else out * _STEPS[size] + part
            done += size
        if 2 * size > Q:
            return out * _SPREAD
        run = run[:-size] * _STEPS[size] + run[size:]
        size *= 2


@dataclass
class Index:
    """The pieces of a set of items and where each of their q-grams stands."""

    pieces: list[tuple[list[int], int, int, np.ndarray]]  # rows of its items, edits, bound, code points
    grams: np.ndarray  # sorted
    owners: np.ndarray  # piece of each, 32 bits
    places: np.ndarray  # offset in its piece, 16 bits
    table: np.ndarray  # whether some gram falls on a slot

    @classmethod
    def of(cls, texts: list[str | None], chars: np.ndarray) -> Index:
        pieces, grams, owners, places = [], [], [], []
        known: dict[bytes, list[int]] = {}
        for row, text in enumerate(texts):
            codes = normalized(text, chars)[0]
            if len(codes) < Q:
                continue
            starts = [0] if len(codes) < 3 * PIECE // 2 else [*range(0, len(codes) - PIECE, PIECE // 2), len(codes) - PIECE]
            for start in starts:
                part = codes[start : start + PIECE] if len(starts) > 1 else codes
                # Items that repeat, or repeat themselves, share their pieces.
                rows = known.setdefault(part.tobytes(), [])
                fresh = not rows
                if row not in rows[-1:]:
                    rows.append(row)
                if not fresh:
                    continue
                m = len(part)
                edits = max(0, min(int(EDITS * m), m // Q - 1)) if m >= SHORT else 0
                found = _grams(part)
                grams.append(found)
                owners.append(np.full(len(found), len(pieces), np.int32))
                places.append(np.arange(len(found), dtype=np.int16))
                pieces.append((rows, edits, m + 1 - Q * (edits + 1), part))
        every = np.concatenate(grams) if grams else np.empty(0, U)
        order = np.argsort(every, kind="stable")
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(every >> U(64 - _TABLE_BITS)).astype(np.int64)] = True
        join = lambda parts, kind: np.concatenate(parts)[order] if parts else np.empty(0, kind)
        return cls(pieces, every[order], join(owners, np.int32), join(places, np.int16), table)

    def __post_init__(self) -> None:
        self.edits = np.array([p[1] for p in self.pieces], np.int64)
        self.bounds = np.array([p[2] for p in self.pieces], np.int64)
        self.reach = max((len(p[3]) + 2 * (p[1] + 1) for p in self.pieces), default=0)

    def plain(self) -> tuple:
        return self.pieces, self.grams, self.owners, self.places, self.table

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(piece, first diagonal, last diagonal) of the bands that reach the bound."""
        grams = _grams(codes)
        at = np.flatnonzero(self.table[(grams >> U(64 - _TABLE_BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return []
        low, high = np.searchsorted(self.grams, grams[at]), np.searchsorted(self.grams, grams[at], "right")
        some = high > low
        at, low, times = at[some], low[some], (high - low)[some]
        if not len(at):
            return []
        # Stretches with few hits at a time; what a band needs lies within a piece's reach.
        total = np.append(0, np.cumsum(times))
        bands: list[tuple[int, int]] = []
        start = 0
        while start < len(at):
            stop = int(np.searchsorted(total, total[start] + HITS, "right")) - 1
            stop = max(stop, int(np.searchsorted(at, at[start] + STRETCH)), start + 1)
            end = int(np.searchsorted(at, at[stop - 1] + self.reach, "right"))
            bands += self._reached(at[start:end], low[start:end], times[start:end])
            start = stop
        found: list[tuple[int, int, int]] = []
        for piece, band in sorted(set(bands)):
            width = self.pieces[piece][1] + 1
            first, last = band * width - _SHIFT, (band + 2) * width - _SHIFT - 1
            if found and found[-1][0] == piece and first <= found[-1][2]:
                found[-1] = (piece, found[-1][1], last)
            else:
                found.append((piece, first, last))
        return found

    def _reached(self, at: np.ndarray, low: np.ndarray, times: np.ndarray) -> list[tuple[int, int]]:
        """(piece, band) of the bands of a stretch that reach the bound. Each place of a
        piece counts once for a band; the hits are brought to that a part at a time."""
        keys = np.empty(0, np.int64)
        total = np.append(0, np.cumsum(times))
        for begin in range(0, int(total[-1]), HITS):
            which = np.arange(begin, min(begin + HITS, int(total[-1])))
            hit = np.searchsorted(total, which, "right") - 1
            entry = low[hit] + which - total[hit]
            owner, place = self.owners[entry].astype(np.int64), self.places[entry].astype(np.int64)
            band = (at[hit] - place + _SHIFT) // (self.edits[owner] + 1)
            part = [(owner << 43) | ((band - back) << 8) | place for back in (0, 1)]
            keys = np.unique(np.concatenate([keys, *part]))
        both = keys >> 8
        opens = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        counts = np.diff(np.append(opens, len(both)))
        both = both[opens]
        both = both[counts >= self.bounds[both >> 35]]
        return list(zip((both >> 35).tolist(), (both & ((1 << 35) - 1)).tolist(), strict=True))

    def matches(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item row, start, end, edits) of every piece found, by start."""
        out = []
        for piece, first, last in self.regions(codes):
            rows, edits, _, part = self.pieces[piece]
            if len(part) < SHORT:
                hits = [(d, d + len(part), 0) for d in _as_words(part, codes, first, last)]
            else:
                hit = aligned(part, codes, first, last, edits)
                hits = [] if hit is None else [hit]
            out += [(row, *hit) for hit in hits for row in rows]
        return sorted(out, key=lambda x: (x[1], x[0]))


def _as_words(part: np.ndarray, codes: np.ndarray, first: int, last: int) -> list[int]:
    """Where ``part`` stands unchanged on these diagonals, with no letter or digit at its sides."""
    m, n = len(part), len(codes)
    at = [d for d in range(max(first, 0), min(last, n - m) + 1) if np.array_equal(codes[d : d + m], part)]
    return [d for d in at if (d == 0 or codes[d - 1] == 32) and (d + m == n or codes[d + m] == 32)]


def aligned(part: np.ndarray, codes: np.ndarray, first: int, last: int, edits: int) -> tuple[int, int, int] | None:
    """Best place (start, end, edits) of ``part`` on diagonals ``first`` to ``last``
    and ``edits`` beyond, or None if it takes more than ``edits``.

    One row of the table per character of ``part``, one column per diagonal.
    """
    low, high = max(first - edits, -edits), min(last + edits, len(codes) - len(part) + edits)
    if high < low:
        return None
    m = len(part)
    for d in range(max(low, 0), min(high, len(codes) - m) + 1):
        if np.array_equal(codes[d : d + m], part):
            return d, d + m, 0
    diagonals = np.arange(low, high + 1)
    far = m + 1
    steps = np.arange(len(diagonals))
    cost = np.where(diagonals >= 0, 0, far)  # nothing of the piece used, at any place
    origin = diagonals.copy()
    for i in range(m):
        at = diagonals + i
        inside = (at >= 0) & (at < len(codes))
        same = np.zeros(len(diagonals), bool)
        same[inside] = codes[at[inside]] == part[i]
        direct = np.where(inside, cost + ~same, far)
        # A character of the piece that the text lacks: from one diagonal further.
        lacking = np.append(cost[1:] + 1, far)
        take = lacking < direct
        row = np.where(take, lacking, direct)
        came = np.where(take, np.append(origin[1:], 0), origin)
        # Characters that the text has in excess: along the row, one each.
        run = row - steps
        best = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == best, steps, 0))
        cost, origin = np.minimum(best + steps, far), came[source]
        if i == 0:
            fresh = np.where((diagonals + 1 >= 0) & (diagonals + 1 <= len(codes)), 1, far)
            better = fresh < cost
            cost, origin = np.where(better, fresh, cost), np.where(better, diagonals + 1, origin)
    ends = diagonals + m
    cost = np.where((ends >= 0) & (ends <= len(codes)), cost, far)
    j = int(np.argmin(cost))
    if cost[j] > edits:
        return None
    return max(int(origin[j]), 0), int(ends[j]), int(cost[j])


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, one at a time."""
    held, size = [], 0
    for row in items.select(quoted(item_id).cast("string").alias("i"), quoted(text).alias("t")).orderBy("i", "t").toLocalIterator():
        held.append((row["i"], row["t"]))
        size += len(row["t"] or "")
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    yield held


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", name: str = "leaks") -> DataFrame:
    """``docs`` with ``leaks``: (item, start, end, edits) of every benchmark
    passage found, positions in code points of the text, item ids as text.

    Null and empty texts have none; null and empty items and those below ``Q``
    characters match nothing; repeated items are found each, and repeated rows
    come out alike. Case is ignored in the basic plane; beyond it every code
    point counts as a letter as it is. A column named like the result is
    replaced. The benchmark is the query set: it is sent to the tasks in
    blocks of bounded size. One block is searched in one pass and no document
    is shuffled; of several, each has a pass of its own that keeps what it
    finds by text, and only that is joined to the documents.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == name.lower()])
    blocks = _blocks(items, item_id, item_text)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return _searched(docs, block, text, name)[0]
    texts = docs.select(F.unhex(F.md5(F.coalesce(quoted(text), F.lit("")))).alias("key"), quoted(text).alias("text"))
    hits = None
    for block in chain([block, more], blocks):
        found, shared = _searched(texts, block, "text", "hits")
        # Copies of a text have the same passages.
        found = stage(found.where(F.size("hits") > 0).groupBy("key").agg(F.first("hits").alias("hits")), "passages")
        shared.unpersist()
        hits = found if hits is None else hits.union(found)
    by_text = hits.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("hits")), lambda a, b: _order(a, b)).alias(name))
    key = _unused(docs, "text_key")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(quoted(text), F.lit("")))))
    told = lookup(keyed, by_text.withColumnRenamed("key", key), key)
    return told.select(*map(quoted, docs.columns), F.coalesce(quoted(name), F.array().cast(_LEAKS)).alias(name))


def _order(a: Column, b: Column) -> Column:
    key = lambda x: F.struct(x["start"], x["end"], x["item"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def _unused(df: DataFrame, name: str) -> str:
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


_LEAKS = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("start", "end", "edits")]]))


def _searched(docs: DataFrame, block: list[tuple], text: str, name: str) -> tuple[DataFrame, Broadcast]:
    """``docs`` with the passages of one block of items, and what was sent for that."""
    arrow_kind = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    ids = [i for i, _ in block]
    index = Index.of([t for _, t in block], _char_table())
    shared = docs.sparkSession.sparkContext.broadcast((ids, *index.plain()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *parts = shared.value
        index, chars = Index(*parts), _char_table()
        for batch in batches:
            for part, texts in text_slices(batch, text):
                out = [[] for _ in texts]
                for found, value in zip(out, texts, strict=True):
                    codes, at = normalized(value, chars)
                    for row, a, b, edits in index.matches(codes):
                        if b > a:
                            found.append({"item": ids[row], "start": int(at[a]), "end": int(at[min(b, len(at)) - 1]) + 1, "edits": edits})
                yield added(part, {name: pa.array(out, arrow_kind)})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, _LEAKS)])), shared


def contaminated(name: str = "leaks"):
    return F.size(quoted(name)) > 0
