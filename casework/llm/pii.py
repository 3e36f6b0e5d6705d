"""Personal data: identifiers of fixed form, and others that stand where those stand.

Base finder: e-mail addresses, IP addresses, card and phone numbers by form
and check digits. They are the seeds of a bootstrap over a graph of patterns
(the words before a token, or around it) and instances (tokens that could be
an identifier): a pattern is trusted for a kind as far as its instances are
known to be of that kind, an instance is believed as far as trusted patterns
surround it, and both are scored in turn until the set of trusted patterns
stays the same. Tokens in the place of a trusted pattern are reported as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.skew import lookup
from .common import added, quoted, stage, text_slices

KINDS = ("email", "ip", "card", "phone")
# Kinds of what the patterns find, in the order of the base kinds.
NEAR_KINDS = tuple(f"near_{k}" for k in KINDS)
# A pattern is trusted from this mean belief in its instances on; one more
# instance, unbelieved, is always counted.
TRUST = 0.6
# Belief in distinct instances that a pattern needs.
SUPPORT = 3
# Rounds of scoring at most; they end when no further pattern is trusted.
ROUNDS = 8

# The forms of the base kinds.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never begins inside a row of digits: one that begins earlier in it fails or succeeds alike.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
# Shorter ones have too few digits and are dropped whole.
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN = re.compile(r"(?<!\S)(?=\S*[0-9@])\S+")
_EDGE = "\"'`´.,;:!?()[]{}<>|*#$%&=~"
_BEFORE = re.compile(r"\S+")
# Code points before and after a token that its patterns look at.
REACH = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; end exclusive, in code points."""
    found = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


def _could_be(token: str) -> list[int]:
    """Kinds that a token has the make of; the place has to say the rest."""
    digits = sum(c in "0123456789" for c in token)
    kinds = []
    if len(token) >= 5 and any(c.isalpha() for c in token):
        kinds.append(0)
    if digits >= 4 and sum(c in ".:" for c in token) >= 2:
        kinds.append(1)
    if 12 <= digits <= 19:
        kinds.append(2)
    if 5 <= digits <= 15:
        kinds.append(3)
    return kinds


def _word(word: str) -> str:
    return re.sub(r"[0-9]", "0", word.lower())[:24]


def patterns(text: str, start: int, end: int) -> list[str]:
    """What surrounds a token: the two words before it, and the words at both sides."""
    before = [_word(w) for w in _BEFORE.findall(text[max(0, start - REACH) : start])][-2:]
    after = _BEFORE.search(text[end : end + REACH])
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {_word(after.group())}")
    return out


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None, list[int], int, list[str]]]:
    """(start, end, kind or None, kinds it could be, instance, patterns) of base
    spans and of other tokens with a digit or an at sign; an instance is a hash,
    so that no identifier is kept in the graph."""
    out = []
    for kind, start, end in base:
        out.append((start, end, kind, [kind], _instance(text[start:end]), patterns(text, start, end)))
    taken = sorted((a, b) for _, a, b in base)
    here = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        token = m.group()
        while here < len(taken) and taken[here][1] <= start:
            here += 1
        if here < len(taken) and taken[here][0] < end:
            continue
        start += len(token) - len(token.lstrip(_EDGE))
        token = token.strip(_EDGE)
        kinds = _could_be(token)
        if kinds:
            end = start + len(token)
            out.append((start, end, None, kinds, _instance(token), patterns(text, start, end)))
    return out


def _instance(token: str) -> int:
    value = xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


_SPAN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("kind", "start", "end")])
_SEEN = T.StructType(
    [
        *[T.StructField(c, T.IntegerType()) for c in ("start", "end", "kind")],
        T.StructField("kinds", T.ArrayType(T.IntegerType())),
        T.StructField("instance", T.LongType()),
        T.StructField("patterns", T.ArrayType(T.StringType())),
    ]
)
_ARROW_SPAN = pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "end")]))
_ARROW_SEEN = pa.list_(
    pa.struct(
        [*[(c, pa.int32()) for c in ("start", "end", "kind")], ("kinds", pa.list_(pa.int32())), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]
    )
)


def _scanned(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """The kept columns as ``_0, _1 …``, a key of the text, base spans and occurrences."""
    read = docs.select(*[quoted(c).alias(f"_{i}") for i, c in enumerate(keep)], F.coalesce(quoted(text), F.lit("")).alias("_text"))
    read = read.withColumn("_key", F.unhex(F.md5("_text")))
    kept = [f.name for f in read.schema.fields if f.name != "_text"]
    schema = T.StructType([*[read.schema[c] for c in kept], T.StructField("_base", T.ArrayType(_SPAN)), T.StructField("_seen", T.ArrayType(_SEEN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "kind", "kinds", "instance", "patterns")
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                base = [base_spans(t) for t in texts]
                seen = [[dict(zip(names, x, strict=True)) for x in occurrences(t, b)] for t, b in zip(texts, base, strict=True)]
                spans = [[{"kind": k, "start": a, "end": z} for k, a, z in b] for b in base]
                yield added(part.select(kept), {"_base": pa.array(spans, _ARROW_SPAN), "_seen": pa.array(seen, _ARROW_SEEN)})

    return read.mapInArrow(run, schema)


def trusted_patterns(seen: DataFrame, trust: float = TRUST, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, kind, trust, support`` of the patterns that the bootstrap comes to trust.

    ``seen`` holds occurrences: ``instance``, ``kind`` (null unless it is of
    base form), ``kinds`` and ``patterns``. Instances count once per pattern,
    so copies of a text add nothing. A pattern with fewer instances than the
    least support can never be trusted and is left out from the start.
    """
    rows = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind", "kinds")
    edges = rows.select("pattern", "instance", "kind", F.explode("kinds").alias("as_kind"))
    edges = edges.groupBy("pattern", "instance", "as_kind").agg(F.max(F.coalesce(F.col("kind") == F.col("as_kind"), F.lit(False))).alias("seed"))
    per_instance = edges.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("_n"))
    totals = per_instance.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= support)
    totals = stage(totals, "pattern-totals")
    edges = stage(lookup(edges, totals, "pattern", "inner"), "pattern-edges")

    seeds = edges.where("seed").select("instance", "as_kind").distinct().withColumn("belief", F.lit(1.0))
    beliefs, before, trusted = seeds, None, None
    for _ in range(rounds):
        told = lookup(edges, beliefs, ["instance", "as_kind"], "inner")
        scored = told.groupBy("pattern", "as_kind").agg(F.sum("belief").alias("support"), F.first("total").alias("total"))
        scored = scored.withColumn("trust", F.col("support") / (F.col("total") + 1))
        trusted = stage(scored.where((F.col("trust") >= trust) & (F.col("support") >= support)).select("pattern", "as_kind", "trust", "support"), "trusted")
        now = trusted.count()
        if now == before:
            break
        before = now
        placed = lookup(edges, trusted.select("pattern", "as_kind", "trust"), ["pattern", "as_kind"], "inner")
        doubt = F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.99)))))
        believed = placed.groupBy("instance", "as_kind").agg((1 - doubt).alias("belief"))
        beliefs = stage(seeds.unionByName(believed).groupBy("instance", "as_kind").agg(F.max("belief").alias("belief")), "beliefs")
    return trusted.withColumnRenamed("as_kind", "kind")


def find(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), trust: float = TRUST, support: int = SUPPORT
) -> DataFrame:
    """The columns ``keep`` with ``base`` (kind, start, end of identifiers of
    base form, by kind and start) and ``spans`` (those and what trusted
    patterns find, whose kinds follow the base kinds).

    A null text is empty; an empty text has no spans. Spans follow from the
    text alone, so repeated rows come out alike, null ids too. Offsets are code
    points, ends exclusive. Of a token with several trusted patterns the most
    trusted kind counts, of equal ones the first.
    """
    scanned = stage(_scanned(docs, text, keep), "identifiers")
    seen = scanned.where(F.size("_seen") > 0).select("_key", F.explode("_seen").alias("s")).select("_key", "s.*")
    trusted = trusted_patterns(seen, trust, support)
    # One text stands for all its copies.
    open_ = seen.where("kind is null").dropDuplicates(["_key", "start"])
    asked = open_.select("_key", "start", "end", "kinds", F.explode("patterns").alias("pattern"))
    asked = asked.select("_key", "start", "end", "pattern", F.explode("kinds").alias("kind"))
    met = lookup(asked, trusted.select("pattern", "kind", "trust"), ["pattern", "kind"], "inner")
    best = met.groupBy("_key", "start", "end").agg(F.min(F.struct((-F.col("trust")).alias("minus"), "kind")).alias("best"))
    span = F.struct((F.col("best.kind") + len(KINDS)).alias("kind"), "start", "end")
    more = stage(best.groupBy("_key").agg(F.sort_array(F.collect_list(span)).alias("_more")), "placed-identifiers")
    told = lookup(scanned.drop("_seen"), more, "_key", "left")
    spans = F.when(F.col("_more").isNull(), F.col("_base")).otherwise(F.concat("_base", "_more"))
    return told.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("_base").alias("base"), spans.alias("spans"))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def told(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS + NEAR_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
