"""Toxic passages as maximum-scoring segments of token log-odds.

1. Counts: in how many texts of the whole corpus, of the toxic and of the
   clean labelled rows a token occurs, in one pass. The corpus share of a token is its Dirichlet prior.
   Beginnings of words are tokens beside whole words, with the sums of their
   words' counts: a language that builds words from parts has few words that
   are frequent by themselves.
2. Scores: log-odds of a token between the two classes, shrunk towards zero by
   its standard error. A word scores as the best of itself and its beginnings,
   less a small cost, so that ordinary text scores below zero.
3. Scan: one linear pass finds all maximal segments of positive score.
4. Calibration: the best segments of clean labelled rows give the two
   parameters of an extreme-value law; a segment's score becomes a p-value for
   the length of its text, the p-values of a text add up to its evidence, and
   a logistic curve over the evidence gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import added, quoted, stage, text_slices

# Labelled rows of each class that the model is fitted to, chosen by a hash of
# their id; about this many, whatever the number of labels.
TRAIN_ROWS = 20_000
# Whole words that the model holds, and as many beginnings: those most surely told apart.
MODEL_TOKENS = 50_000
# Code points of the beginnings that are tokens.
BEGINNINGS = (4, 8)
# Ends a token that is a beginning; no word holds it.
CUT = "*"
# Weight of the corpus distribution, in token counts, against those of a class.
PRIOR_TOKENS = 2_000.0
# Standard errors that a log-odds value is drawn towards zero by.
SHRINK = 2.0
# Cost of a word: a passage pays if it has a telling word among some dozens.
COST = 0.15
# Scores of distinct words that a task remembers at a time.
REMEMBERED = 1 << 17
# Steps of the tables that calibration collects; both tables are of fixed size.
SCORE_STEP, SCORE_STEPS = 0.25, 4_000
EVIDENCE_STEP, EVIDENCE_STEPS = 0.25, 2_000

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def segments(scores: np.ndarray, cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal segments ``(start, end, score)`` in linear time.

    ``scores`` are token scores before the cost. Only positive tokens can open
    or close a segment, so the pass runs over those and the sums between them.
    """
    net = scores - cost
    at = np.flatnonzero(net > 0)
    if not len(at):
        return []
    total = np.append(0.0, np.cumsum(net))
    found: list[list] = []  # start, end, sum before, sum up to the end, earlier entry with a smaller sum before
    for start in at.tolist():
        start_sum, end_sum, end = total[start], total[start + 1], start + 1
        while True:
            back = len(found) - 1
            while back >= 0 and found[back][2] >= start_sum:
                back = found[back][4]
            if back < 0 or found[back][3] >= end_sum:
                found.append([start, end, start_sum, end_sum, back])
                break
            start, start_sum = found[back][0], found[back][2]
            del found[back:]
    return [(a, b, float(y - x)) for a, b, x, y, _ in found]


@dataclass(frozen=True)
class Model:
    """Token scores, and what turns segment scores into one score per text."""

    weights: dict[str, float]
    slope: float = 1.0  # of the extreme-value law
    size: float = 1.0
    bias: float = -4.0
    gain: float = 0.0

    def weigher(self) -> Callable[[str], float]:
        """A function from a word to the best of it and its beginnings, 0 if the model has none of them."""
        least, most = BEGINNINGS
        whole = {t: w for t, w in self.weights.items() if not t.endswith(CUT)}
        starts = {t[: -len(CUT)]: w for t, w in self.weights.items() if t.endswith(CUT)}
        heads = {t[:least] for t in starts}

        def weight(word: str) -> float:
            best = whole.get(word)
            if len(word) > least and word[:least] in heads:
                for n in range(least, min(most, len(word) - 1) + 1):
                    w = starts.get(word[:n])
                    if w is not None and (best is None or w > best):
                        best = w
            return best or 0.0

        return weight

    def weight(self, word: str) -> float:
        return self.weigher()(word)

    def scanner(self) -> Callable[[str | None], tuple[int, list[tuple[int, int, float]]]]:
        """A function from a text to its number of words and its segments; it remembers words."""
        known: dict[str, float] = {}
        weight = self.weigher()

        def scan(text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
            words = tokens(text)
            if len(known) > REMEMBERED:
                known.clear()
            for word in set(words).difference(known):
                known[word] = weight(word)
            return len(words), segments(np.fromiter(map(known.__getitem__, words), float, len(words)))

        return scan

    def surprise(self, length: int, score: float) -> float:
        """Minus the log of the chance of such a segment in clean text of this length."""
        log_e = math.log(self.size * max(length, 1)) - self.slope * score
        return -log_e if log_e < -30 else -math.log(max(-math.expm1(-math.exp(min(log_e, 50.0))), 1e-300))

    def evidence(self, length: int, found: list[tuple[int, int, float]]) -> float:
        return sum(s for *_, score in found if (s := self.surprise(length, score)) > 3.0)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.bias + self.gain * evidence))))


def _sampled(labels: DataFrame, id_col: str, label: str, rows: int) -> DataFrame:
    """About ``rows`` labelled ids of each class, chosen by hash; an id with
    several labels is toxic if one of them is."""
    labels = labels.where(quoted(id_col).isNotNull() & quoted(label).isNotNull())
    labels = labels.groupBy(quoted(id_col).alias("_id")).agg((F.max(quoted(label)) > 0).cast("int").alias("_toxic"))
    counts = {r["_toxic"]: r["n"] for r in labels.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for value, n in counts.items():
        share = F.when(F.col("_toxic") == value, F.lit(min(1.0, rows / n))).otherwise(share)
    return labels.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))


def _token_counts(docs: DataFrame) -> DataFrame:
    schema = "token string, n long, toxic long, clean long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text", 4 << 20, 2048):
                every, by_class = Counter(), (Counter(), Counter())
                for text, label in zip(texts, part.column("_toxic").to_pylist(), strict=True):
                    words = set(tokens(text))
                    every.update(words)
                    if label is not None:
                        by_class[label].update(words)
                names = list(every)
                columns = [every.values(), map(by_class[1].__getitem__, names), map(by_class[0].__getitem__, names)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), *[pa.array(list(c), pa.int64()) for c in columns]],
                    names=["token", "n", "toxic", "clean"],
                )

    found = docs.mapInArrow(run, schema)
    return found.groupBy("token").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _weights(counts: DataFrame, tokens_kept: int, prior: float, shrink: float) -> dict[str, float]:
    totals = counts.agg(F.sum("n"), F.sum("toxic"), F.sum("clean")).first()
    if not all(totals):
        return {}
    n, n_toxic, n_clean = map(float, totals)
    alpha = F.col("n") * (prior / n)
    toxic, clean = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = F.log(toxic / (n_toxic + prior)) - F.log(clean / (n_clean + prior))
    error = F.sqrt(1 / toxic + 1 / clean)
    told = counts.where("toxic + clean > 0").select(
        "token", (F.signum(odds) * F.greatest(F.abs(odds) - shrink * error, F.lit(0.0))).alias("w"), F.abs(odds / error).alias("z")
    )
    kept = told.where("w <> 0").orderBy(F.desc("z"), "token").limit(tokens_kept).collect()
    return {r["token"]: float(r["w"]) for r in kept}


def _beginnings(counts: DataFrame) -> DataFrame:
    """Counts of the beginnings of words that are longer: the sums over those words."""
    least, most = BEGINNINGS
    cut = F.expr(f"transform(sequence({least}, least({most}, length(token) - 1)), n -> concat(substring(token, 1, n), '{CUT}'))")
    rows = counts.where(F.length("token") > least).select(F.explode(cut).alias("token"), "n", "toxic", "clean")
    return rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")])


def _gumbel(table: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Slope and size of the law from a table of (score step, log2 length, rows),
    by its quartiles above the texts without a positive segment."""
    if not table:
        return 1.0, 1.0
    step, length, rows = (np.array(c, float) for c in zip(*table, strict=True))
    score = step * SCORE_STEP
    order = np.argsort(score)
    share = np.cumsum(rows[order]) / rows.sum()
    low, high = (float(score[order][np.searchsorted(share, q)]) for q in (0.5, 0.9))
    spread = max(high - low, 1.0)
    # Quantiles of the standard law lie at -log(-log(q)).
    slope = (-math.log(-math.log(0.9)) + math.log(-math.log(0.5))) / spread
    mean_length = float((2.0**length * rows).sum() / rows.sum())
    mode = low + math.log(math.log(2.0)) / slope
    return slope, math.exp(slope * mode) / mean_length


def _logistic(evidence: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Bias and gain of a logistic curve over binned evidence, by Newton steps."""
    bias, gain = math.log((toxic.sum() + 1) / (clean.sum() + 1)), 0.0
    x, n, y = evidence, toxic + clean, toxic
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(bias + gain * x, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(y - n * p).sum(), ((y - n * p) * x).sum() - 1e-3 * gain])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        bias, gain = bias + move[0], max(gain + move[1], 0.0)
        if np.abs(move).max() < 1e-6:
            break
    return float(bias), float(gain)


def _scanned(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        scan = held.scanner()
        for batch in batches:
            rows = []
            labelled = ((t, y) for part, texts in text_slices(batch, "_text") for t, y in zip(texts, part.column("_toxic").to_pylist(), strict=True))
            for text, toxic in labelled:
                length, found = scan(text)
                best = max((s for *_, s in found), default=0.0)
                value = min(held.evidence(length, found), 1e6)
                rows.append(
                    (
                        toxic,
                        min(int(best / SCORE_STEP), SCORE_STEPS),
                        max(length, 1).bit_length() - 1,
                        min(int(value / EVIDENCE_STEP), EVIDENCE_STEPS),
                    )
                )
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int32()) for c in zip(*rows, strict=True)], names=["toxic", "best", "log_n", "evidence"]
                )

    return docs.mapInArrow(run, "toxic int, best int, log_n int, evidence int")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = TRAIN_ROWS,
    tokens_kept: int = MODEL_TOKENS,
) -> Model:
    """Fit the model; ``usable`` says, by label row, which labels may be used.

    Token counts cover every document; class counts cover about ``rows``
    labelled documents of each class. Without usable labels of both classes
    the model scores everything near zero.
    """
    if usable is not None:
        labels = labels.where(usable)
    chosen = _sampled(labels, id_col, label, rows)
    read = docs.select(quoted(id_col).alias("_id"), quoted(text).alias("_text"))
    counts = _token_counts(read.join(F.broadcast(chosen), "_id", "left").select("_text", "_toxic"))
    counts = stage(counts, "token-counts")
    starts = stage(_beginnings(counts), "beginning-counts")
    model = Model(_weights(counts, tokens_kept, PRIOR_TOKENS, SHRINK) | _weights(starts, tokens_kept, PRIOR_TOKENS, SHRINK))
    if not model.weights:
        return model
    train = read.join(F.broadcast(chosen), "_id").select("_text", "_toxic")
    best = _scanned(train, model).where("toxic = 0").groupBy("best", "log_n").count().collect()
    slope, size = _gumbel([tuple(r) for r in best])
    model = Model(model.weights, slope, size)
    table = _scanned(train, model).groupBy("evidence").agg(F.sum("toxic").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    x, y, n = (np.array(c, float) for c in zip(*[tuple(r) for r in table], strict=True))
    bias, gain = _logistic(x * EVIDENCE_STEP, y, n - y)
    return Model(model.weights, slope, size, bias, gain)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` and ``passages``: the
    significant segments as (first token, end token, p-value).

    A word is a run of letters in lower case; digits separate words. A null or
    empty text, or one without words, has no passage and the lowest score.
    Equal texts score alike, so repeated rows and null ids do. Columns with
    these names are replaced.
    """
    names = ("score", "predicted", "passages")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))
    passage = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    arrow_passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.ArrayType(passage))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        scan = held.scanner()
        for batch in batches:
            for part, texts in text_slices(batch, text):
                scores, passages = [], []
                for value in texts:
                    length, found = scan(value)
                    scores.append(held.score(held.evidence(length, found)))
                    told = [(a, b, held.surprise(length, s)) for a, b, s in found]
                    passages.append([{"start": a, "end": b, "p": math.exp(-s)} for a, b, s in told if s > 3.0])
                predicted = [int(s >= 0.5) for s in scores]
                columns = pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(passages, arrow_passage)
                yield added(part, dict(zip(names, columns, strict=True)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from learning: by the CRC of its id as text. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(quoted(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))

