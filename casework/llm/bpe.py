"""Byte-level BPE by replaying merges over the distinct pre-tokens of many texts.

A task gathers the distinct pre-tokens of its texts into one sequence of
symbols and keeps an inverted index from each mergeable pair to the positions
where it stands. Merges are applied in rank order, each to all its positions;
only the two neighbours of a touched position are looked up again.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from .common import added, text_slices

# Text whose distinct pre-tokens are merged together, in characters.
CHUNK = 1 << 20
# Largest rank file that is sent to executors.
MAX_RANK_BYTES = 64 << 20
# Pieces of text whose ids a task remembers; it starts anew beyond.
REMEMBERED = 60_000
# The code points with Unicode's White_Space property (fixed values).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SHIFT = 24
# What stands for the end of a word and for a symbol merged into its left one.
_END, _GONE = -1, -2


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        data = lines.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class MergeReplay:
    """Encodes pre-tokens; holds the vocabulary and the table of mergeable pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) >= 1 << _SHIFT:
            raise ValueError("ranks do not fit the pair table")
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        # Length of each token; an end mark and a symbol that is gone fit no pair.
        self.size = np.full(max(ranks.values()) + 3, 1 << 30)
        pairs = []
        for token, rank in ranks.items():
            self.size[rank] = len(token)
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << _SHIFT | right, rank))
        self.keys, self.key_ranks = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()
        self.byte_pairs = self._ranks_of(*np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij"))
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        # Pre-tokens never cross a space but for one that leads them, so a text
        # is first cut into these larger pieces, most of which repeat.
        self.piece = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.piece.findall(text) for text in texts]
        fresh = set(itertools.chain.from_iterable(pieces)).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = set(itertools.chain.from_iterable(pieces))
        if fresh:
            # Letters behind one space at most are one pre-token as they stand.
            parts = {p: self.pattern.findall(p) for p in fresh if not (p.isalpha() or p[0] == " " and p[1:].isalpha())}
            tokens = list(fresh.difference(parts).union(*parts.values()))
            ids = dict(zip(tokens, self.replay([t.encode("utf-8", "surrogatepass") for t in tokens]), strict=True))
            for piece, split in parts.items():
                self.known[piece] = b"".join([ids[t] for t in split])
            self.known.update((piece, ids[piece]) for piece in fresh.difference(parts))
        return [b"".join(map(self.known.__getitem__, split)) for split in pieces]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids; -1 where there is none."""
        wanted = np.where(right < 0, -1, left << _SHIFT | right)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.key_ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word after all merges, lowest rank first, leftmost first."""
        flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        symbols = self.byte_ids[flat]
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        symbols[ends] = _END
        before = np.arange(-1, len(flat) - 1)
        before[0] = -1
        before[ends[:-1] + 1] = -1
        size, index, queue = self.size, {}, []

        def note(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
                rank = int(ranks[start])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].append(positions[start:stop])

        ranks = self.byte_pairs[flat[:-1], flat[1:]]
        ranks[ends[:-1]] = ranks[ends - 1] = -1
        held = np.flatnonzero(ranks >= 0)
        if len(held):
            note(held, ranks[held])
        again = []
        while queue:
            rank = heapq.heappop(queue)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            # The bytes at a position never change, so a pair still stands there
            # if the position is a symbol's and the two lengths still add up.
            left = symbols[at]
            right_at = np.minimum(at + size[left], len(symbols) - 1)
            keep = (left >= 0) & (size[left] + size[symbols[right_at]] == size[rank])
            at, right_at = at[keep], right_at[keep]
            if len(at) > 1 and (chained := right_at[:-1] == at[1:]).any():
                opens = np.flatnonzero(np.append(True, ~chained))
                place = np.arange(len(at)) - np.repeat(opens, np.diff(np.append(opens, len(at))))
                at, right_at = at[place % 2 == 0], right_at[place % 2 == 0]
            if not len(at):
                continue
            symbols[at], symbols[right_at] = rank, _GONE
            after = at + size[rank]
            before[after] = at
            led = at[before[at] >= 0]
            near = np.concatenate([before[led], at])
            new = self._ranks_of(symbols[near], np.concatenate([symbols[led], symbols[after]]))
            near, new = near[new >= 0], new[new >= 0]
            if len(new):
                if new.min() <= rank:
                    again.append(near[new <= rank])
                note(near, new)
        live = symbols >= 0
        counts = np.add.reduceat(live, np.append(0, ends[:-1] + 1))
        ids = symbols[live].astype("<u4").tobytes()
        bounds = (4 * np.append(0, np.cumsum(counts))).tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        # Where a merge made one of lower rank possible, which tables of trained
        # merges do not show, that word alone is replayed one step at a time.
        for word in np.unique(np.searchsorted(ends, np.concatenate(again))) if again else ():
            out[word] = self.one_by_one(words[word])
        return out

    def one_by_one(self, word: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            ranks = self._ranks_of(ids[:-1], ids[1:])
            if (ranks < 0).all():
                break
            at = int(np.argmin(np.where(ranks < 0, 1 << _SHIFT, ranks)))
            ids = np.concatenate([ids[:at], [ranks[at]], ids[at + 2 :]])
        return ids.astype("<u4").tobytes()


def _without(df: DataFrame, name: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() == name.lower()])


def _decoded(values: list[bytes | None], token) -> pa.Array:
    return pa.array([b"".join(map(token, np.frombuffer(v or b"", "<u4").tolist())) for v in values], pa.binary())


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids``: the token ids of each whole text, little-endian
    unsigned 32-bit integers in one binary value. With ``decoded`` the ids are
    decoded again in the same pass, into a column of that name.

    A null text counts as empty and gives empty ids; repeated rows are encoded
    alike. A column already named ``ids`` is replaced. No shuffle.
    """
    df = _without(_without(df, ids), decoded or ids)
    added_names = [ids, decoded] if decoded else [ids]
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(*shared.value)
        token = {rank: token for token, rank in shared.value[0].items()}.__getitem__
        for batch in batches:
            for part, texts in text_slices(batch, text, CHUNK, 1024):
                found = replay.encode([t or "" for t in texts])
                columns = [pa.array(found, pa.binary()), *([_decoded(found, token)] if decoded else [])]
                yield added(part, dict(zip(added_names, columns, strict=True)))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(c, T.BinaryType()) for c in added_names]]))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for. Null ids count as none; an
    id outside the vocabulary fails the job. A column already named
    ``decoded`` is replaced. No shuffle."""
    df = _without(df, decoded)
    shared = df.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            column = batch.column(ids)
            size = 128
            for start in range(0, len(column), size):
                yield added(batch.slice(start, size), {decoded: _decoded(column.slice(start, size).to_pylist(), token)})

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())]))
