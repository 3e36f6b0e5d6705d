"""Reconcile documents, age open items and check bookings.

Money is in whole cents and quantities in whole units, so sums do not depend
on the order rows are added in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_filled
from .skew import BROADCAST_ROWS, ROWS_PER_CHUNK, lookup

DEFAULT_CHART = "SKR03"


def cents(amount: Column | str) -> Column:
    """A decimal amount held as double to whole cents, half up."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.floor(amount * 100 + 0.5).cast("bigint")


def per_key(lines: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """Lines summed per document; partial sums first, so a long document is cheap."""
    return lines.groupBy(key).agg(F.sum(value).cast("bigint").alias(out), F.count(F.lit(1)).alias(f"n_{out}"))


def match_sides(
    left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str,
    status: Sequence[tuple[str, Column]],
) -> DataFrame:
    """Full outer join of two per-document tables; both sides are unique on ``key``."""
    joined = left.select(key, left_value).join(right.select(key, right_value), key, "full_outer")
    label = F.lit(None).cast("string")
    for name, condition in reversed(list(status)):
        label = F.when(condition, name).otherwise(label)
    return joined.select(key, left_value, right_value, label.alias("status"))


def reconcile_orders(
    orders: DataFrame, invoices: DataFrame, key: str = "po_number", tolerance_cents: int = 0
) -> DataFrame:
    """Order lines against invoice lines: ``key, po_cents, invoice_cents, status, difference_cents``.

    Both inputs are lines with ``key`` and ``cents``. A status names the
    record that is missing: ``missing_po`` or ``missing_invoice``.
    """
    po = per_key(orders, key, F.col("cents"), "po_cents")
    invoice = per_key(invoices, key, F.col("cents"), "invoice_cents")
    difference = F.col("invoice_cents") - F.col("po_cents")
    matched = match_sides(
        po, invoice, key, "po_cents", "invoice_cents",
        [
            ("missing_po", F.col("po_cents").isNull()),
            ("missing_invoice", F.col("invoice_cents").isNull()),
            ("matched", F.abs(difference) <= tolerance_cents),
            ("amount_mismatch", F.lit(True)),
        ],
    )
    return matched.withColumn("difference_cents", difference)


def reconcile_deliveries(deliveries: DataFrame, invoices: DataFrame, key: str = "po_number") -> DataFrame:
    """Delivered against invoiced units: ``key, delivered, invoiced, status, shortfall``.

    ``shortfall`` is what was invoiced and not delivered; a missing side counts as none.
    """
    delivered = per_key(deliveries, key, F.col("quantity"), "delivered")
    invoiced = per_key(invoices, key, F.col("quantity"), "invoiced")
    matched = match_sides(
        delivered, invoiced, key, "delivered", "invoiced",
        [
            ("missing_delivery", F.col("delivered").isNull()),
            ("missing_invoice", F.col("invoiced").isNull()),
            ("matched", F.col("delivered") == F.col("invoiced")),
            ("short_delivery", F.col("delivered") < F.col("invoiced")),
            ("over_delivery", F.lit(True)),
        ],
    )
    gap = F.coalesce("invoiced", F.lit(0)) - F.coalesce("delivered", F.lit(0))
    return matched.withColumn("shortfall", F.greatest(gap, F.lit(0)).cast("bigint"))


def status_totals(reconciled: DataFrame, left_value: str, right_value: str) -> DataFrame:
    return reconciled.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(left_value).cast("bigint").alias(left_value),
        F.sum(right_value).cast("bigint").alias(right_value),
    )


def age_open_items(
    items: DataFrame, as_of: Column, levels: Sequence[tuple[int, int]], due: str = "due_on", current: str = "current_level"
) -> DataFrame:
    """Add ``days_overdue``, ``dunning_level`` and ``escalate`` to open items.

    ``levels`` are ``(level, from_days)``. They are literals of the plan: the
    level reached is the highest whose bound has passed, 0 for none.
    """
    days = F.datediff(as_of, F.col(due))
    bands = sorted(levels, key=lambda b: b[1])
    reached = F.greatest(F.lit(0), F.lit(0), *[F.when(days >= start, level).otherwise(0) for level, start in bands])
    return items.withColumns(
        {"days_overdue": F.greatest(days, F.lit(0)).cast("bigint"), "dunning_level": reached.cast("bigint")}
    ).withColumn("escalate", F.col("dunning_level") > F.coalesce(F.col(current), F.lit(0)))


def age_open_items_by(
    items: DataFrame,
    levels: DataFrame,
    as_of: Column,
    due: str = "due_on",
    current: str = "current_level",
    customer: str = "customer",
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """``age_open_items`` with levels from a table: per customer, and by the day an item fell due.

    ``levels`` holds ``customer, level, from_days, valid_from, valid_to``; a
    level holds for items due from the first day up to, not including, the
    last, and a null day is no bound. Levels without a customer hold for items
    of customers that have no level at all, and of none. An item without a day
    due has no level.

    The levels of a customer are cut by calendar year and gathered, so an item
    meets one row by its customer and year, not a range: no pair of an item
    and a level that is not of its year is made. The years cut are those that
    items fall due in, a few rows taken from them beforehand.
    """
    years = items.where(F.col(due).isNotNull()).select(F.year(due).alias("_year")).distinct()
    day = F.struct("level", "from_days", "valid_from", "valid_to")
    first, last = F.make_date("_year", F.lit(1), F.lit(1)), F.make_date(F.col("_year") + 1, F.lit(1), F.lit(1))
    spread = levels.withColumn("_year", F.explode(F.lit(sorted(r["_year"] for r in years.collect())).cast("array<int>")))
    within = (F.col("valid_from").isNull() | (F.col("valid_from") < last)) & (F.col("valid_to").isNull() | (F.col("valid_to") > first))
    gathered = spread.where(within).groupBy(customer, "_year").agg(F.collect_list(day).alias("_levels"))
    own = gathered.where(F.col(customer).isNotNull())
    general = gathered.where(F.col(customer).isNull()).select("_year", F.col("_levels").alias("_general"))
    known = levels.where(F.col(customer).isNotNull()).select(customer).distinct().withColumn("_known", F.lit(True))
    bounds = {"broadcast_rows": broadcast_rows, "rows_per_task": rows_per_task}
    rows = lookup(items.withColumn("_year", F.year(due)), own, [customer, "_year"], **bounds)
    rows = lookup(lookup(rows, known, customer, **bounds), general, "_year", **bounds)
    mine = F.when(F.coalesce("_known", F.lit(False)), F.col("_levels")).otherwise(F.col("_general"))
    days = F.datediff(as_of, F.col(due))

    def reached(x: Column) -> Column:
        holds = (x["valid_from"].isNull() | (x["valid_from"] <= F.col(due))) & (x["valid_to"].isNull() | (x["valid_to"] > F.col(due)))
        return holds & (x["from_days"] <= days)

    level = F.array_max(F.transform(F.filter(mine, reached), lambda x: x["level"]))
    level = F.greatest(F.coalesce(level, F.lit(0)), F.lit(0)).cast("bigint")
    rows = rows.select(*items.columns, F.greatest(days, F.lit(0)).cast("bigint").alias("days_overdue"), level.alias("dunning_level"))
    return rows.withColumn("escalate", F.col("dunning_level") > F.coalesce(F.col(current), F.lit(0)))


def map_bookings(
    postings: DataFrame, chart: DataFrame, default_chart: str = DEFAULT_CHART,
    broadcast_rows: int = BROADCAST_ROWS, rows_per_task: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``chart``, ``booking_code`` and ``in_chart`` to postings.

    ``postings`` hold ``account`` and an optional ``chart``; ``chart`` holds
    ``chart, account, booking_code``, unique on the first two.
    """
    stated = F.when(is_filled("chart"), F.col("chart")).otherwise(default_chart)
    named = postings.withColumn("chart", stated)
    codes = chart.select("chart", "account", "booking_code", F.lit(True).alias("_listed"))
    joined = lookup(named, codes, ["chart", "account"], "left", broadcast_rows, rows_per_task)
    return joined.select(
        *named.columns, "booking_code", F.coalesce("_listed", F.lit(False)).alias("in_chart")
    )


def bookings_outside_chart(postings: DataFrame, chart: DataFrame, default_chart: str = DEFAULT_CHART) -> DataFrame:
    """Uses per account and chart for accounts the chart does not list, counted before the join."""
    stated = F.when(is_filled("chart"), F.col("chart")).otherwise(default_chart)
    used = postings.groupBy(stated.alias("chart"), "account").agg(F.count(F.lit(1)).alias("n_postings"))
    return lookup(used, chart.select("chart", "account"), ["chart", "account"], "left_anti").select(*used.columns)


def approval_queue(invoices: DataFrame, amount: str, limit_cents: int = 1_000_000) -> DataFrame:
    """Invoices above the limit, which a person has to approve."""
    return invoices.where(F.col(amount) > limit_cents)


def straight_through(invoices: DataFrame, amount: str, limit_cents: int = 1_000_000) -> DataFrame:
    """The other side of ``approval_queue``; an unknown amount goes to neither."""
    return invoices.where(F.col(amount) <= limit_cents)
