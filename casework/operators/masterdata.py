"""Vendor master data: enrich cases, check record quality and identifier consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.envelope import wrap
from ..functions.text import any_of, first_match, text_or_empty
from .skew import BROADCAST_ROWS, lookup, row_hash

# Fixed value: a German VAT id as it appears in free text.
VAT_ID = r"(?U)\b(DE\d{6,12})\b"

# The three outcome messages.
NO_ID = "No vendor identifier (USt-IdNr.) found in the task."
NOT_FOUND = "Vendor {} not found in master data."
FOUND = "Vendor {} located. Name: {} IBAN (REQUIRES non-LLM revalidation before payment): {}"


def fill(template: str, *values: Column) -> Column:
    """``str.format`` with positional columns."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def vendor_summary(fields: Sequence[str]) -> Column:
    """The outcome text; a field that vendor records lack shows as empty text."""
    shown = [text_or_empty(F.col(f"vendor.{f}").cast("string")) if f in fields else F.lit("") for f in ("name", "iban")]
    found = fill(FOUND, F.col("vendor_id"), *[wrap(value, "datev") for value in shown])
    return (
        F.when(F.col("vendor_id").isNull(), NO_ID)
        .when(~F.col("found"), fill(NOT_FOUND, F.col("vendor_id")))
        .otherwise(found)
    )


def vendor_records(vendors: DataFrame, changed: str | None = None) -> DataFrame:
    """``vendor_id`` and all other columns as one struct, one row per id.

    A record with nothing in it does not count. Of rows with one id the one
    with the highest ``changed`` is taken, null being lowest, and of equals
    or without ``changed`` the one of a fixed hash: a table has no last row.
    """
    fields = [c for c in vendors.columns if c != "vendor_id"]
    first = [F.col(f"`{changed}`").desc_nulls_last()] if changed else []
    order = Window.partitionBy("vendor_id").orderBy(*first, row_hash(vendors))
    known = vendors.where("vendor_id is not null").withColumn("_place", F.row_number().over(order)).where("_place = 1")
    filled = any_of([F.col(f"`{f}`").isNotNull() for f in fields])
    return known.where(filled).select("vendor_id", F.struct(*[F.col(f"`{f}`") for f in fields]).alias("vendor"))


def enrich_vendors(
    cases: DataFrame,
    vendors: DataFrame,
    task: str = "task",
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int | None = None,
    changed: str | None = None,
) -> DataFrame:
    """Add ``vendor_id``, ``found``, ``vendor`` and ``summary`` to each case.

    The first VAT id of the task is looked up in ``vendors``; ``vendor`` holds
    its whole record, see ``vendor_records`` for repeated ids. Many cases may
    name one vendor, or none: see ``lookup``.
    Salting is off by default because counting ids reads all texts once more.
    """
    named = cases.withColumn("vendor_id", first_match(task, VAT_ID))
    joined = lookup(named, vendor_records(vendors, changed), "vendor_id", "left", broadcast_rows, rows_per_task)
    order = [*cases.columns, "vendor_id", "vendor"]
    return (
        joined.select(*order)
        .withColumn("found", F.col("vendor").isNotNull())
        .withColumn("summary", vendor_summary(vendors.columns))
    )


def record_quality(
    records: DataFrame, fields: Sequence[str], changed_on: str, as_of: Column, max_age_days: int
) -> DataFrame:
    """Per field: records, null values, and records not touched for ``max_age_days``.

    A record never touched counts as stale. One aggregation pass.
    """
    stale = F.coalesce(F.datediff(as_of, F.col(changed_on)) > max_age_days, F.lit(True))
    one_row = records.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(stale).alias("n_stale"),
        *[F.count_if(F.col(f).isNull()).alias(f"_null_{f}") for f in fields],
    )
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f"_null_{f}").alias("n_null")) for f in fields]
    )
    return one_row.select("n_records", "n_stale", F.inline(pairs))


def flag_records(
    records: DataFrame, fields: Sequence[str], changed_on: str, as_of: Column, max_age_days: int
) -> DataFrame:
    """Per record: names of its null fields, comma-separated, and whether it is stale."""
    missing = F.concat_ws(",", *[F.when(F.col(f).isNull(), f) for f in fields])
    stale = F.coalesce(F.datediff(as_of, F.col(changed_on)) > max_age_days, F.lit(True))
    return records.withColumns({"null_fields": missing, "is_stale": stale})


def id_consistency(texts: DataFrame, case: str, text: str, pattern: str = VAT_ID) -> DataFrame:
    """Per case: mentions, distinct identifiers, and whether they are missing or inconsistent.

    Counting goes per (case, identifier) first, so a hot case is reduced
    before its rows meet.
    """
    ids = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    mentions = (
        texts.select(case, F.explode_outer(ids).alias("_id"))
        .groupBy(case, "_id")
        .agg(F.count("_id").alias("_n"))
    )
    return (
        mentions.groupBy(case)
        .agg(
            F.sum("_n").alias("n_mentions"),
            F.count("_id").alias("n_ids"),
            F.min("_id").alias("first_id"),
            F.max("_id").alias("last_id"),
        )
        .withColumn(
            "status",
            F.when(F.col("n_ids") == 0, "missing").when(F.col("n_ids") == 1, "consistent").otherwise("inconsistent"),
        )
    )
