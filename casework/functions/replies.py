"""Parse and check structured model replies without leaving the JVM.

The rules are those of a lenient typed model: numbers and words that clearly
mean a truth value are accepted, everything else must have its own type,
unknown keys are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import WS, any_of, col, strip

# Fences around a reply, and the words read as truth values.
FENCE = rf"(?mdU)^```(?:json)?{WS}*|{WS}*```$"
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")
# Text read as a whole number: blanks around it, single underscores between
# digits and a zero fraction are allowed.
WHOLE_NUMBER = rf"(?U)^{WS}*[+-]?[0-9]+(_[0-9]+)*(\.0*)?{WS}*$"

STRICT = {"allowSingleQuotes": "false"}


@dataclass(frozen=True)
class Field:
    """``kind`` is flag, text, optional_text, texts or whole."""

    name: str
    kind: str
    required: bool = False


@dataclass(frozen=True)
class ReplyKind:
    fields: tuple[Field, ...]
    forbidden: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


LISTS = (Field("facts", "texts"), Field("guesses", "texts"), Field("plan", "texts"))
# The first ledger of a case may bring a revision; a later one is numbered by
# the loop, so a revision of its own collides. The task never comes from a reply.
FIRST_LEDGER = ReplyKind((*LISTS, Field("revision", "whole")), forbidden=("task",))
NEXT_LEDGER = ReplyKind(LISTS, forbidden=("task", "revision"))
PROGRESS = ReplyKind(
    (
        Field("is_request_satisfied", "flag", required=True),
        Field("is_in_loop", "flag", required=True),
        Field("is_progress_being_made", "flag", required=True),
        Field("next_speaker", "optional_text"),
        Field("instruction_or_question", "optional_text"),
        Field("final_answer", "optional_text"),
        Field("reasoning", "text"),
    )
)


def unfenced(raw: Column | str) -> Column:
    text = col(raw)
    return strip(F.when(text.contains("```"), F.regexp_replace(text, FENCE, "")).otherwise(text))


def _get(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _is_number(tag: Column) -> Column:
    return tag.isin("BIGINT", "DOUBLE", "FLOAT") | tag.startswith("DECIMAL")


# Readers turn a value and its type tag (null when absent) into the field, or
# null when the value is refused.


def _flag(v: Column, tag: Column) -> Column:
    word, number = F.lower(_get(v, "string")), _get(v, "double")
    is_word = tag.isin("BOOLEAN", "STRING")
    return (
        F.when(is_word & word.isin(*TRUE_WORDS), True)
        .when(is_word & word.isin(*FALSE_WORDS), False)
        .when(_is_number(tag) & (number == 1), True)
        .when(_is_number(tag) & (number == 0), False)
    )


def _text(v: Column, tag: Column) -> Column:
    return F.when(tag.isNull(), "").when(tag == "STRING", _get(v, "string"))


def _optional_text(v: Column, tag: Column) -> Column:
    return F.when(tag == "STRING", _get(v, "string"))


def _texts(v: Column, tag: Column) -> Column:
    items = _get(v, "array<string>")
    whole = tag.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(items, lambda x: x.isNull())
    return F.when(tag.isNull(), F.array().cast("array<string>")).when(whole, items)


def _whole(v: Column, tag: Column) -> Column:
    number, text = _get(v, "double"), _get(v, "string")
    digits = F.regexp_replace(F.regexp_replace(strip(text), r"\.0*$", ""), "_", "")
    return (
        F.when(tag.isNull(), F.lit(0).cast("bigint"))
        .when(tag == "BIGINT", _get(v, "bigint"))
        .when(tag == "BOOLEAN", _get(v, "boolean").cast("bigint"))
        .when(_is_number(tag) & (number == F.floor(number)), _get(v, "bigint"))
        .when((tag == "STRING") & text.rlike(WHOLE_NUMBER), digits.try_cast("bigint"))
    )


READERS = {"flag": _flag, "text": _text, "optional_text": _optional_text, "texts": _texts, "whole": _whole}


def parse_replies(df: DataFrame, raw: str, kind: ReplyKind) -> DataFrame:
    """Add one typed column per field and ``reason``, null for a valid reply.

    Reasons: ``not_json``, ``not_object``, ``key_collision``,
    ``missing:<field>``, ``type:<field>``; the first that applies. The fields
    of a refused reply are null.
    """
    keys = [*kind.names, *[k for k in kind.forbidden if k not in kind.names]]
    shape = "array<struct<" + ",".join(f"{k} variant" for k in keys) + ">>"
    text, found = F.col("_text"), F.col("_object")
    # A reply put into brackets must be exactly one object: this is what
    # refuses trailing text, which a lone object would hide.
    listed = F.concat(F.lit("["), text, F.lit("]"))
    objects = F.from_json(listed, shape, STRICT)
    braced = text.startswith("{") & text.endswith("}")
    # Generators keep what is parsed as a column of its own: a filter on the
    # result is not pushed below them, which would parse once per use.
    staged = (
        df.withColumn("_text", unfenced(raw))
        .withColumn("_objects", objects)
        .withColumn("_object", F.explode_outer(F.when(braced & (F.size("_objects") == 1), F.col("_objects"))))
        .withColumns({f"_tag_{k}": F.schema_of_variant(found[k]) for k in keys})
        .withColumns({f"_value_{f.name}": READERS[f.kind](found[f.name], F.col(f"_tag_{f.name}")) for f in kind.fields})
    )
    one_value = F.size(F.from_json(listed, "array<variant>", STRICT)) == 1
    reason = (
        F.when(found.isNull() & ~text.startswith("{") & one_value, "not_object")
        .when(found.isNull(), "not_json")
        .when(any_of([F.col(f"_tag_{k}").isNotNull() for k in kind.forbidden]), "key_collision")
    )
    for field in kind.fields:
        tag, value = F.col(f"_tag_{field.name}"), F.col(f"_value_{field.name}")
        may_lack = field.kind == "optional_text"
        refused = tag.isNotNull() & (tag != "VOID") & value.isNull() if may_lack else value.isNull()
        if field.required:
            reason = reason.when(tag.isNull(), f"missing:{field.name}")
        reason = reason.when(refused, f"type:{field.name}")
    checked = F.struct(*[F.col(f"_value_{n}").alias(n) for n in kind.names], reason.alias("reason"))
    out = staged.select(*df.columns, F.explode(F.array(checked)).alias("_checked"))
    fields = [F.when(F.col("_checked.reason").isNull(), F.col(f"_checked.{n}")).alias(n) for n in kind.names]
    return out.select(*df.columns, *fields, F.col("_checked.reason").alias("reason"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def quarantined(parsed: DataFrame, kind: ReplyKind) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).drop(*kind.names)
