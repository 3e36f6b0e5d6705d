"""Header fields of extracted invoice text, with a list of those not found."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.text import first_match

# Our own patterns; a caller passes others for other layouts.
HEADER_FIELDS = {
    "invoice_number": r"(?i)(?:rechnung|invoice)(?:s?(?:nummer|number|nr\.?|no\.?))?[ :#]+([A-Z0-9-]*[0-9][A-Z0-9-]*)",
    "invoice_date": r"\b([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})\b",
    "supplier": r"(?i)(?:lieferant|supplier)[ :]+([^,;\n]+)",
    "total": r"(?i)(?:betrag|total|summe)[ :]+(?:EUR ?)?([0-9][0-9.,]*[0-9])",
    "tax_id": r"\b(DE[0-9]{6,12})\b",
}


def extract_fields(df: DataFrame, text: str, fields: Mapping[str, str] = HEADER_FIELDS) -> DataFrame:
    """Add one column per field, null when not found, and ``low_confidence`` naming those."""
    found = df.withColumns({name: first_match(text, pattern) for name, pattern in fields.items()})
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in fields]))
    return found.withColumn("low_confidence", missing)
