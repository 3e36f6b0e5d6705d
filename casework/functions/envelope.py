"""Trust envelopes as column expressions: wrap, defang, detect, count."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import WS, col, count_matches

# The source taxonomy and the envelope format.
SOURCES = ("ocr", "datev", "github", "search", "langfuse", "git", "env", "worker")
TAG = "external_content"
OPEN_NESTED = "<external_content_NESTED>"
CLOSE_NESTED = "</external_content_NESTED>"

# A word boundary after the tag name, spelled out because Java and Python
# disagree on combining marks.
OPEN_PATTERN = rf"(?iU)<{WS}*{TAG}(?![\p{{L}}\p{{N}}_])[^>]*>"
CLOSE_PATTERN = rf"(?iU)<{WS}*/{WS}*{TAG}{WS}*>"


def defang(text: Column | str) -> Column:
    """Rename envelope tags inside untrusted text so they cannot close the outer one."""
    opened = F.regexp_replace(col(text), OPEN_PATTERN, OPEN_NESTED)
    return F.regexp_replace(opened, CLOSE_PATTERN, CLOSE_NESTED)


def known_source(source: Column | str) -> Column:
    """True when the source belongs to the taxonomy; null counts as unknown."""
    return F.coalesce(col(source).isin(*SOURCES), F.lit(False))


def wrap(text: Column | str, source: Column | str, custom_ok: bool = False) -> Column:
    """Defang ``text`` and put it into an envelope.

    ``source`` is a taxonomy name or a column of such names. Any other name
    is refused, at build time for a name and at run time for a column, unless
    ``custom_ok`` is set: a source is not escaped inside the tag. Null text
    stays null.
    """
    if isinstance(source, str):
        if not custom_ok and source not in SOURCES:
            raise ValueError(f"unknown source: {source}")
        label = F.lit(source)
    elif custom_ok:
        label = source
    else:
        message = F.concat(F.lit("unknown source: "), F.coalesce(source, F.lit("null")))
        label = F.when(known_source(source), source).otherwise(F.raise_error(message))
    return F.concat(F.lit(f'<{TAG} source="'), label, F.lit('">'), defang(text), F.lit(f"</{TAG}>"))


def has_envelope(text: Column | str) -> Column:
    """An opening and a closing tag somewhere in the text, in any order."""
    return col(text).rlike(OPEN_PATTERN) & col(text).rlike(CLOSE_PATTERN)


def forged_tags(text: Column | str) -> Column:
    """How many tags ``defang`` would rename; opening tags go first, as there."""
    opened = F.regexp_replace(col(text), OPEN_PATTERN, OPEN_NESTED)
    return count_matches(text, OPEN_PATTERN) + count_matches(opened, CLOSE_PATTERN)
