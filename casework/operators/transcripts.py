"""Case transcripts: dispatch rows in, one prompt-ready text per case out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.envelope import wrap
from ..functions.text import is_filled, text_or_empty
from .skew import WIDE_ROWS_PER_CHUNK, OrderedLog

# An empty transcript, and the speaker whose lines are not wrapped.
EMPTY = "(empty)"
TRUSTED = "orchestrator"
# Bytes of a transcript part, far below the 2 GB a string cell may hold.
PART_BYTES = 64 << 20


def transcript_line(speaker: str, content: str, trusted: str = TRUSTED) -> Column:
    """``[speaker] content``; anything not said by the trusted speaker is enveloped."""
    said = text_or_empty(content)
    body = F.when(F.col(speaker) == trusted, said).otherwise(wrap(said, "worker"))
    return F.concat(F.lit("["), text_or_empty(speaker), F.lit("] "), body)


def _joined(grouped: DataFrame, case: str, seq: str, *columns: Column) -> DataFrame:
    """Lines of a group in ``seq`` order; two at one place have no order and fail the job."""
    orders = F.transform("_entries", lambda e: e[seq])
    duplicate = F.size(F.array_distinct(orders)) < F.size(orders)
    text = F.when(
        duplicate, F.raise_error(F.concat(F.lit("duplicate seq in case "), F.col(case).cast("string")))
    ).otherwise(F.array_join(F.transform("_entries", lambda e: e["_line"]), "\n"))
    return grouped.select(case, *columns, F.size("_entries").cast("bigint").alias("n_lines"), text.alias("_text"))


def _entries(seq: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(seq, "_line"))).alias("_entries")


def join_lines(df: DataFrame, case: str, seq: str, line: Column, out: str) -> DataFrame:
    """Join lines in ``seq`` order, one row per case: ``(case, n_lines, out)``.

    A case's text is one cell and so is built by one task, whatever its
    length; ``transcript_parts`` is for cases too long for a cell (2 GB). Two
    rows with one ``(case, seq)`` fail the job.
    """
    grouped = df.select(case, seq, line.alias("_line")).groupBy(case).agg(_entries(seq))
    return _joined(grouped, case, seq).withColumnRenamed("_text", out)


def assemble_transcripts(
    transcript: DataFrame,
    case: str = "case_id",
    seq: str = "seq",
    speaker: str = "speaker",
    content: str = "content",
    trusted: str = TRUSTED,
    cases: DataFrame | None = None,
) -> DataFrame:
    """One ``transcript`` text per case, however many lines it has.

    With ``cases`` given, cases that have no rows get ``(empty)``. Those are
    found on case ids alone, so texts are never shuffled for them.
    """
    texts = join_lines(transcript, case, seq, transcript_line(speaker, content, trusted), "transcript")
    if cases is None:
        return texts
    silent = cases.select(case).distinct().join(transcript.select(case).distinct(), case, "left_anti")
    return texts.unionByName(
        silent.select(case, F.lit(0).cast("bigint").alias("n_lines"), F.lit(EMPTY).alias("transcript"))
    )


def transcript_parts(
    transcript: DataFrame,
    case: str = "case_id",
    seq: str = "seq",
    speaker: str = "speaker",
    content: str = "content",
    trusted: str = TRUSTED,
    part_bytes: int = PART_BYTES,
    rows_per_chunk: int = WIDE_ROWS_PER_CHUNK,
) -> DataFrame:
    """Transcripts as consecutive parts: ``(case, part, n_lines, transcript)``.

    The parts of a case, joined by a newline, are its whole transcript. A part
    begins within ``part_bytes`` and so holds at most its last line more. The
    cut is made on ids and line sizes; texts are shuffled by row and by part,
    so a task never holds a long case. Case keys must not be null.
    """
    rows = transcript.select(case, seq, transcript_line(speaker, content, trusted).alias("_line"))
    sizes = rows.select(case, seq, (F.octet_length("_line") + 1).cast("bigint").alias("_size"))
    log = OrderedLog.of(sizes, case, seq, rows_per_chunk=rows_per_chunk).running_sum("_before", F.col("_size"), inclusive=False)
    placed = log.result.select(case, seq, F.expr(f"_before div {part_bytes}").alias("_cut"))
    # A line longer than a part leaves a gap in the cuts; one row per part closes it.
    order = Window.partitionBy(case).orderBy("_cut")
    numbers = placed.select(case, "_cut").distinct().withColumn("part", (F.row_number().over(order) - 1).cast("bigint"))
    grouped = rows.join(placed, [case, seq]).groupBy(case, "_cut").agg(_entries(seq))
    texts = _joined(grouped, case, seq, F.col("_cut")).join(numbers, [case, "_cut"])
    return texts.select(case, "part", "n_lines", F.col("_text").alias("transcript"))


def dispatch_rows(dispatches: DataFrame, replies: DataFrame, keys: Sequence[str] = ("case_id", "step")) -> DataFrame:
    """The two transcript rows every dispatch adds: the order given and the reply.

    ``dispatches`` holds ``keys, next_speaker, instruction``; ``replies``
    holds ``keys, reply``. A step without a speaker or an instruction adds
    nothing. The join key is unique per step, so no key can be hot.
    """
    case, step = keys
    sent = dispatches.where(is_filled("next_speaker") & is_filled("instruction"))
    return step_rows(sent.join(replies.select(*keys, "reply"), list(keys), "left"), case, step)


def step_rows(sent: DataFrame, case: str = "case_id", step: str = "seq") -> DataFrame:
    """``case, seq, speaker, content``: the order and the reply of each dispatch that was
    made, with its ``next_speaker``, ``instruction`` and ``reply`` in one row. No shuffle."""
    order = F.struct(
        F.lit(TRUSTED).alias("speaker"),
        F.concat(F.lit("-> "), F.col("next_speaker"), F.lit(": "), F.col("instruction")).alias("content"),
    )
    answer = F.struct(F.col("next_speaker").alias("speaker"), text_or_empty("reply").alias("content"))
    return sent.select(
        case, F.col(step).cast("bigint").alias("_step"), F.posexplode(F.array(order, answer)).alias("_pos", "_row")
    ).select(case, (F.col("_step") * 2 + F.col("_pos")).alias("seq"), "_row.speaker", "_row.content")
