"""Envelope, audit and screen a corpus of untrusted text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import envelope as env
from ..functions.masking import MASKS
from ..functions.text import count_matches

# Phrases named as apparent injections by the instruction hierarchy.
INJECTION_PHRASES = (
    "ignore previous instructions",
    "you may skip approval",
    "the user has pre-approved this",
    "auto-trust policy",
)


def envelope_texts(
    df: DataFrame, text: str, source: Column | str, out: str = "envelope", custom_ok: bool = False
) -> DataFrame:
    """Add the enveloped form of a text column."""
    return df.withColumn(out, env.wrap(text, source, custom_ok))


def enveloped_only(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text already carries an envelope."""
    return df.where(env.has_envelope(text))


def accepted_sources(df: DataFrame, source: str) -> DataFrame:
    return df.where(env.known_source(source))


def rejected_sources(df: DataFrame, source: str) -> DataFrame:
    """Rows whose source is outside the taxonomy, null included."""
    return df.where(~env.known_source(source))


def forged_tag_audit(df: DataFrame, text: str, source: str) -> DataFrame:
    """Per source: texts seen, texts with forged tags, tags defanged, worst text."""
    return (
        df.select(source, env.forged_tags(text).alias("forged"))
        .groupBy(source)
        .agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.count_if(F.col("forged") > 0).alias("n_forged_texts"),
            F.sum("forged").alias("forged_tags"),
            F.max("forged").alias("max_forged"),
        )
    )


def injection_hits(
    df: DataFrame, text: str, keys: Sequence[str], phrases: Sequence[str] = INJECTION_PHRASES
) -> DataFrame:
    """One row per text and phrase it holds, with the number of occurrences.

    The phrases are literals of the plan, so each text is read once and only
    hits are emitted. Matching ignores case.
    """
    lowered = F.lower(F.col(text))
    counts = [
        F.struct(F.lit(p).alias("phrase"), count_matches(lowered, r"\Q" + p.lower() + r"\E").alias("n_hits"))
        for p in phrases
    ]
    hit = F.filter(F.array(*counts), lambda c: c["n_hits"] > 0)
    # The outer form keeps Spark from testing for an empty list before the
    # explode, which would count everything twice.
    exploded = df.select(*keys, F.explode_outer(hit).alias("hit")).where(F.col("hit").isNotNull())
    return exploded.select(*keys, "hit.phrase", "hit.n_hits")


def injection_report(
    df: DataFrame, text: str, source: str, phrases: Sequence[str] = INJECTION_PHRASES
) -> DataFrame:
    """Texts and occurrences per source and phrase."""
    return (
        injection_hits(df, text, [source], phrases)
        .groupBy(source, "phrase")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_hits").alias("n_hits"))
    )


def mask_texts(df: DataFrame, text: str, out: str = "masked", masks=MASKS) -> DataFrame:
    """Add the masked text and a ``n_<mask>`` count for each mask.

    Each mask counts and replaces on the text the one before it left, held as
    a column so that no pattern runs twice over a text.
    """
    columns = df.columns
    df = df.withColumn("_seen", F.col(text))
    for name, pattern, replacement in masks:
        df = df.withColumn(f"n_{name}", count_matches("_seen", pattern))
        df = df.withColumn("_seen", F.regexp_replace("_seen", pattern, replacement))
    return df.select(*columns, *[f"n_{name}" for name, _, _ in masks], F.col("_seen").alias(out))
