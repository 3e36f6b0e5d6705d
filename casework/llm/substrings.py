"""Repeated passages, found through anchors at the positions of a difference cover.

A cover modulo a period has, for any two positions, a shift below the period
that moves both into it. So of two equal runs of ``WINDOW`` words some pair of
equally shifted, shorter windows ("anchors") lies at cover positions in both
texts, and hashing windows at cover positions alone loses no repeat. Anchors
that occur twice mark the windows that may repeat; only those are extended to
full windows, whose first place decides what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_filter, quoted, stage, text_slices
from .words import NOT_SPACE, U, mix, windows, word_hashes

WINDOW = 20
# A difference cover: the differences of its members give every rest modulo the period.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
_LAST = (1 << 63) - 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _split(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return blobs, *word_hashes(blobs, NOT_SPACE)


def _kept(blob: bytes, removed: np.ndarray | None) -> tuple[int, int, str]:
    words = blob.split()
    kept = words if removed is None else [w for w, gone in zip(words, removed.tolist(), strict=True) if not gone]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


_RESULT = "_k long, n_words long, n_removed long, kept_sha256 string"


def _untouched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                yield _rows(part.column("_k"), [_kept((t or "").encode("utf-8", "surrogatepass"), None) for t in texts])

    return docs.mapInArrow(run, _RESULT)


def _rows(keys: pa.Array, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    n, removed, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["_k", "n_words", "n_removed", "kept_sha256"]
    )


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, _k, at) for every cover position of texts that have a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                keys = part.column("_k").to_numpy(zero_copy_only=False)
                _, words, first = _split(texts)
                every = windows(words, ANCHOR)
                owner = np.repeat(np.arange(len(texts)), np.diff(first))[: len(every)]
                at = np.arange(len(every)) - first[owner]
                count = np.diff(first)[owner]
                use = _IN_COVER[at % PERIOD] & (at + ANCHOR <= count) & (count >= WINDOW)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[use].view(np.int64)), pa.array(keys[owner[use]]), pa.array(at[use].astype(np.int32))], names=["anchor", "_k", "at"]
                )

    return docs.mapInArrow(run, "anchor long, _k long, at int")


def _candidates(count: int, anchors: np.ndarray) -> np.ndarray:
    """Starts of the windows of a text of ``count`` words that hold one of the anchors."""
    starts = np.unique((np.asarray(anchors, np.int64)[:, None] - np.arange(PERIOD)).ravel())
    return starts[(starts >= 0) & (starts + WINDOW <= count)]


def _window_keys(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window."""
    return windows(words, WINDOW)[starts], windows(mix(words), WINDOW, 2)[starts]


def _extended(marked: DataFrame) -> DataFrame:
    """Distinct candidate windows of each text: (w1, w2, _k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "_text"):
                keys, anchors = (rows.column(c).to_pylist() for c in ("_k", "ats"))
                _, words, first = _split(texts)
                parts = []
                for i in range(len(texts)):
                    own = words[first[i] : first[i + 1]]
                    pair = np.stack(_window_keys(own, _candidates(len(own), anchors[i])), 1)
                    order = np.lexsort((pair[:, 1], pair[:, 0]))
                    pair = pair[order]
                    new = np.append(True, (pair[1:] != pair[:-1]).any(1))[: len(pair)]
                    parts.append((pair[new], keys[i]))
                every = np.concatenate([p for p, _ in parts]).view(np.int64)
                owner = np.repeat([k for _, k in parts], [len(p) for p, _ in parts])
                yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1]), pa.array(owner.astype(np.int64))], names=["w1", "w2", "_k"])

    return marked.mapInArrow(run, "w1 long, w2 long, _k long")


def _removed(marked: DataFrame) -> DataFrame:
    """Texts with anchors and the windows that are theirs first: what is left of each."""

    def one(own: np.ndarray, anchors: list[int], firsts: np.ndarray) -> np.ndarray:
        starts = _candidates(len(own), anchors)
        w1, w2 = _window_keys(own, starts)
        key = mix(w1 ^ mix(w2))
        _, index = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[index] = False  # the first of its kind in this text
        gone = starts[again | ~np.isin(key, firsts)]
        edge = np.zeros(len(own) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        return np.cumsum(edge)[:-1] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                anchors, firsts = part.column("ats"), part.column("firsts")
                blobs, words, first = _split(texts)
                rows = []
                for i in range(len(texts)):
                    own = words[first[i] : first[i + 1]]
                    known = np.array(firsts[i].as_py() or [], np.int64).view(U)
                    rows.append(_kept(blobs[i], one(own, anchors[i].as_py(), known)))
                yield _rows(part.column("_k"), rows)

    return marked.mapInArrow(run, _RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed`` and the
    digest of the words that stay, ``kept_sha256``.

    A word goes if a window of ``WINDOW`` words over it begins earlier too: in
    a text of smaller id, or before in the same text. Null and empty texts have
    no words. Rows that share an id count as one text in several rows: none of
    them comes before another. Null ids come last. Other columns are not read.
    """
    read = docs.select(F.coalesce(quoted(id_col).cast("long"), F.lit(_LAST)).alias("_k"), quoted(text).alias("_text"))
    anchors = _anchors(read)
    twice = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    shared = anchors.join(twice.hint("merge"), "anchor", "left_semi").groupBy("_k").agg(F.collect_set("at").alias("ats"))
    shared = stage(shared, "shared-anchors")

    maybe = id_filter(shared, "_k")
    marked = stage(read.where(maybe(F.col("_k"))).join(shared, "_k"), "marked-texts")
    firsts = _extended(marked).groupBy("w1", "w2").agg(F.min("_k").alias("_k"))
    owned = stage(_first_keys(firsts), "first-windows")
    touched = _removed(marked.join(owned, "_k", "left"))
    untouched = _untouched(read).join(shared.select("_k"), "_k", "left_anti")
    out = untouched.unionByName(touched)
    return out.select(F.when(F.col("_k") != _LAST, F.col("_k")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def _first_keys(firsts: DataFrame) -> DataFrame:
    """The keys of the windows that a text has first, one list per text; no longer than the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w1, w2 = (batch.column(c).to_numpy(zero_copy_only=False).view(U) for c in ("w1", "w2"))
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(mix(w1 ^ mix(w2)).view(np.int64))], names=["_k", "w"])

    return firsts.mapInArrow(run, "_k long, w long").groupBy("_k").agg(F.collect_list("w").alias("firsts"))
