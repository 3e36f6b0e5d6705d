"""Secrets in texts, and weak candidates confirmed by their counterparts.

Built-in functions only. Strong findings stand alone. A weak part (a name, a
secret or an endpoint that may be harmless) counts only if a complementary
part lies within ``SCOPE`` code points: parts are joined as intervals, on the
row, the counterpart's role and the stretch of text, then by distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import brought_back, quoted, set_apart, stage

# The patterns of the strong kinds, in the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

# Weak parts by role; group 1 is the value.
_SET = r"""["']?\x20*[:=]\x20*["']?"""
WEAK = {
    "id": r"(?i)\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?|key_?id)" + _SET + r"([A-Za-z0-9@._+-]{3,})",
    "secret": r"(?i)\b(?:pass|pwd|pw|auth|credentials?|private_?key|secret_?access_?key)" + _SET + r"([A-Za-z0-9+/_.=-]{6,})",
    "endpoint": r"""(?i)\b((?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s"'<>]+)""",
}
KINDS = ("assign", "access", "hex", *WEAK)
# Roles of the strong kinds, and what each weak role needs beside it.
ROLES = {"assign": "secret", "access": "id", "hex": "secret"}
NEEDS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
SCOPE = 200
MASK = "[SECRET]"

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose group has ``least`` characters.

    Matches and the pieces between them take turns, so their lengths give the
    positions in code points.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    steps = F.zip_with(
        F.arrays_zip(whole.alias("m"), value.alias("v")),
        F.slice(between, 1, F.greatest(F.size(whole), F.lit(1))),
        lambda x, before: F.struct(
            F.length(before).alias("gap"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("len"), F.coalesce(F.length(x["v"]), F.lit(0)).alias("has")
        ),
    )
    start = F.struct(F.lit(0).alias("at"), _none().alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["len"]
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        kept = F.when((x["has"] >= least) & (x["len"] > 0), F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    return F.aggregate(steps, start, step)["found"]


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(_none())


def strong_spans(text: Column) -> Column:
    """Spans of the strong kinds by start, then kind; cheap tests come first."""
    assign = _when((F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(ASSIGN), _spans(text, "assign", ASSIGN, 2, ASSIGN_LEAST))
    # A run that is too short ends where a longer one would, so the least
    # length can be part of these two patterns.
    access = _when(F.contains(text, F.lit("AKIA")), _spans(text, "access", r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4), 0, ACCESS_LEAST))
    least_hex = r"[0-9a-f]{%d,}" % HEX_LEAST
    hexes = _when(text.rlike(least_hex), _spans(text, "hex", least_hex, 0, HEX_LEAST))
    return F.array_sort(F.concat(assign, access, hexes))


def weak_spans(text: Column) -> Column:
    tests = {
        "id": F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")),
        "secret": F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")),
        "endpoint": F.contains(text, F.lit("://")),
    }
    return F.concat(*[_when(tests[role] & text.rlike(p), _spans(text, role, p, 1, 3)) for role, p in WEAK.items()])


def _stretches(begin: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(begin / SCOPE), F.floor(end / SCOPE)))


def _confirmed(rows: DataFrame) -> DataFrame:
    """Of the weak spans of ``rows`` (_k1, _k2, _strong, _weak), those with a counterpart in reach, by row."""
    strong_role = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in ROLES.items()) + ")")
    part = rows.select("_k1", "_k2", F.explode(F.concat("_strong", "_weak")).alias("s")).select(
        "_k1", "_k2", F.coalesce(strong_role[F.col("s.kind")], F.col("s.kind")).alias("_role"), F.col("s.start").alias("_a"), F.col("s.end").alias("_b")
    )
    part = part.withColumn("_at", _stretches(F.col("_a"), F.col("_b")))
    needs = F.expr("map(" + ", ".join(f"'{k}', array({', '.join(map(repr, v))})" for k, v in NEEDS.items()) + ")")
    weak = rows.select("_k1", "_k2", F.explode("_weak").alias("s")).withColumn("_role", F.explode(needs[F.col("s.kind")]))
    weak = weak.withColumn("_at", _stretches(F.greatest(F.col("s.start") - SCOPE, F.lit(0)), F.col("s.end") + SCOPE))
    near = (part["_a"] <= weak["s.end"] + SCOPE) & (part["_b"] >= weak["s.start"] - SCOPE)
    same = [weak[c] == part[c] for c in ("_k1", "_k2", "_role", "_at")]
    met = weak.join(part, [*same, near], "left_semi").select("_k1", "_k2", "s").distinct()
    return met.groupBy("_k1", "_k2").agg(F.collect_list("s").alias("_added"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``strong`` and ``spans``: arrays of (start, rank, end, kind)
    by start, then kind; ``spans`` has the confirmed weak parts as well.

    A null text counts as empty and has no spans. Rows with equal values get
    equal spans. Columns with these names are replaced. Rows without a weak
    part are never shuffled; the others meet their parts by a hash of the row.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("strong", "spans")])
    docs, names = set_apart(docs)
    value = F.coalesce(F.col(names[text]), F.lit(""))
    plain_cols = [quoted(c) for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    found = docs.select("*", strong_spans(value).alias("strong"), weak_spans(value).alias("_weak"))
    plain = found.where(F.size("_weak") == 0).drop("_weak").withColumn("spans", F.col("strong"))
    keyed = found.where(F.size("_weak") > 0).withColumns({"_k1": F.xxhash64(*plain_cols), "_k2": F.xxhash64(F.lit(1), *plain_cols)})
    rows = stage(keyed.select("_k1", "_k2", F.col("strong").alias("_strong"), "_weak").dropDuplicates(["_k1", "_k2"]), "weak-parts")
    linked = keyed.drop("_weak").join(_confirmed(rows), ["_k1", "_k2"], "left")
    linked = linked.withColumn("spans", F.array_sort(F.concat("strong", F.coalesce("_added", _none()))))
    return brought_back(plain.unionByName(linked.drop("_k1", "_k2", "_added")), names, "strong", "spans")


def told(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every stretch that spans cover replaced by ``mask``; overlapping spans become one."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], gap, F.lit(mask))).otherwise(s["out"])
        first = F.when((s["at"] == 0) & (x["start"] == 0), F.lit(mask)).otherwise(out)
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), first.alias("out"))

    return F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
