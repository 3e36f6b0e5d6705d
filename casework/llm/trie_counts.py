"""Token counts under a unigram model, scored once per prefix of a trie.

A word's best segmentation up to a character depends only on the word's
beginning, so the distinct words of many texts are put into a trie and the
forward score of each of its nodes is computed once, from the nodes above it
that a piece leads from. Nodes where words end keep score and count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, types as T

from .common import added, text_slices

SPACE_MARK = "▁"
CHUNK = 2 << 20
REMEMBERED = 200_000


def read_pieces(path: str) -> dict[str, float]:
    """Pieces of a public model with their log-probabilities.

    The model's order is the frequency order of its pieces; the score of the
    piece at place ``r`` follows from Zipf's law, ``-log(r + 1)`` less a
    constant. Control, unknown and byte pieces are left out.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(plain)}


class Trie:
    """Scores words in sorted order, which walks a trie of them depth first."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        # A character that no piece has falls back to its bytes, one token each.
        self.byte_score = min(pieces.values(), default=0.0) - 2.0
        self.made = 0  # nodes that were computed

    def counts(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """Tokens and score of the best segmentation of each word; of equal
        scores the one whose last piece is longer wins, at every node."""
        find, longest = self.pieces.get, self.longest
        out, path = {}, ""
        score, count = [0.0], [0]  # of the nodes on the path, from the root
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, tokens = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    value = find(word[start:end])
                    if value is not None and score[start] + value > best:
                        best, tokens = score[start] + value, count[start] + 1
                n = len(word[end - 1].encode("utf-8", "surrogatepass"))
                if score[-1] + n * self.byte_score > best:
                    best, tokens = score[-1] + n * self.byte_score, count[-1] + n
                score.append(best)
                count.append(tokens)
                self.made += 1
            path = word
            out[word] = count[-1], score[-1]
        return out


def count_tokens(df: DataFrame, pieces: dict[str, float], text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_tokens`` and ``log_prob`` of each whole text.

    Words are runs between white space, each with a leading mark of its space.
    A null, empty or blank text has no words and no tokens. Equal texts count
    alike. Columns with these names are replaced. No shuffle: a task works on
    the distinct words of a bounded stretch of its rows at a time.
    """
    names = ("n_words", "n_tokens", "log_prob")
    df = df.drop(*[c for c in df.columns if c.lower() in names])
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = Trie(shared.value), {}
        for batch in batches:
            for part, texts in text_slices(batch, text, CHUNK, 1024):
                words = [(t or "").split() for t in texts]
                fresh = {w for ws in words for w in ws}.difference(known)
                if len(known) + len(fresh) > REMEMBERED:
                    known = {}
                    fresh = {w for ws in words for w in ws}
                found = trie.counts([SPACE_MARK + w for w in fresh])
                known.update((w, found[SPACE_MARK + w]) for w in fresh)
                counts = [[known[w] for w in ws] for ws in words]
                columns = [[len(c) for c in counts], [sum(n for n, _ in c) for c in counts], [math.fsum(s for _, s in c) for c in counts]]
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
                yield added(part, dict(zip(names, arrays, strict=True)))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
