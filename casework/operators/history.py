"""How an attribute changed over time, and its value as of a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .skew import ROWS_PER_CHUNK, OrderedLog


def change_intervals(
    log: DataFrame, key: str, seq: str, value: str, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Observations to intervals: ``key, valid_from, valid_to, value``; the last is open.

    ``(key, seq)`` is unique. Consecutive observations of one value make one interval.
    """
    ordered = OrderedLog.ranged(log.select(key, seq, value), key, seq, rows_per_chunk=rows_per_chunk)
    ordered = ordered.neighbour({"_seq": seq, "_before": value})
    changed = F.col("_seq").isNull() | ~F.col(value).eqNullSafe(F.col("_before"))
    ordered = ordered.with_df(ordered.df.where(changed)).neighbour({"valid_to": seq}, ahead=True)
    return ordered.result.select(key, F.col(seq).alias("valid_from"), "valid_to", value)


def value_as_of(
    log: DataFrame,
    probes: DataFrame,
    key: str,
    seq: str,
    value: str,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add to each probe the value last observed at or before its ``seq``, null if none.

    Both sides go through one ordered scan, so neither is expanded into
    intervals nor range-joined, and a key with most rows is cut in chunks.
    """
    observed = log.select(key, seq, F.lit(0).alias("_side"), F.struct(seq, value).alias("_seen"))
    others = [c for c in probes.columns if c not in (key, seq)]
    asked = probes.select(key, seq, F.lit(1).alias("_side"), F.struct(*others).alias("_probe"))
    both = observed.unionByName(asked, allowMissingColumns=True)
    ordered = OrderedLog.ranged(both, key, seq, ties=("_side",), rows_per_chunk=rows_per_chunk)
    ordered = ordered.running_max("_last", F.col("_seen"))
    return ordered.result.where(F.col("_side") == 1).select(
        key, seq, *[F.col(f"_probe.{c}").alias(c) for c in others], F.col(f"_last.{value}").alias(value)
    )
