"""Replay the supervising loop's decisions over logged progress steps.

The loop keeps two counters per case. Both restart or grow at rows that can be
told from the row itself and from how many stalled steps precede it, so the
whole replay is a few running sums and maxima over each case in one sorted
pass: no step list is ever collected. A case with most of the log is cut into
chunks that take their starting counters from a table of one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_filled
from .skew import ROWS_PER_CHUNK, WIDE_ROWS_PER_CHUNK, OrderedLog
from .transcripts import EMPTY

# The loop's limits and the text that stands for a missing answer.
MAX_STALLS = 2
MAX_REPLANS = 2
NO_ANSWER = "(no answer produced)"


def _stalled() -> Column:
    return F.col("is_in_loop") | ~F.col("is_progress_being_made")


def _at_once(log: OrderedLog) -> Column:
    """``seq``, failing on two rows of one case that share it: they have no order."""
    message = F.concat(F.lit("duplicate seq in case "), F.col(log.key).cast("string"))
    same = F.lag(log.seq).over(log.window()) == F.col(log.seq)
    return F.when(same, F.raise_error(message)).otherwise(F.col(log.seq))


def _chunk_carry(log: OrderedLog, limit: int, max_replans: int) -> DataFrame:
    """What each chunk of a case starts with: stalled run, replans asked for, ended or not.

    ``log`` rows carry ``_at`` and ``_restart`` within their chunk, and
    ``_asks`` as if the chunk were the first. Only the waiting rows a chunk
    starts with depend on the chunks before it, and how many of those ask for
    a replan follows from their number.
    """
    leading = F.col("_waiting") & F.col("_restart").isNull()
    chunk = log.cut_rows.groupBy(*log.group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(~F.col("_waiting"), F.col("_at"))).alias("_last"),
        F.count_if(leading).alias("_leading"),
        F.count_if(F.col("_asks") & ~leading).alias("_asks"),
        F.max("is_request_satisfied").alias("_satisfied"),
    )
    before = log.chunk_window()
    zero = F.lit(0).cast("bigint")
    chunk = chunk.withColumn("_start", F.coalesce(F.sum("_n").over(before), zero))
    last_restart = F.max(F.col("_start") + F.col("_last")).over(before)
    chunk = chunk.withColumn("_run_in", F.col("_start") - F.coalesce(last_restart, zero))
    run = F.col("_run_in")
    asked = F.col("_asks") + F.floor((run + F.col("_leading")) / limit) - F.floor(run / limit)
    chunk = chunk.withColumn("_asked_in", F.coalesce(F.sum(asked).over(before), zero).cast("bigint"))
    satisfied = F.coalesce(F.max("_satisfied").over(before), F.lit(False))
    return chunk.select(
        *log.group, "_run_in", "_asked_in", (satisfied | (F.col("_asked_in") > max_replans)).alias("_over_in")
    )


def replay_trace(
    steps: DataFrame,
    max_stalls: int = MAX_STALLS,
    max_replans: int = MAX_REPLANS,
    case: str = "case_id",
    seq: str = "seq",
    rows_per_chunk: int = ROWS_PER_CHUNK,
    counts_from: DataFrame | None = None,
    payload: Sequence[str] = (),
) -> DataFrame:
    """Route and counters of every step: ``case, seq, route, stall_count, replan_count``.

    ``steps`` holds checked flags (``is_request_satisfied``, ``is_in_loop``,
    ``is_progress_being_made``) and ``known_speaker``. Routes: ``dispatch``,
    ``replan``, ``finalize:satisfied``, ``finalize:budget``, and
    ``after_terminal`` for steps logged after a case ended. Counters are those
    after the step, null after the end. ``counts_from``: see ``OrderedLog.ranged``.
    ``payload`` names further columns that go through the one shuffle.
    """
    flags = ["is_request_satisfied", "is_in_loop", "is_progress_being_made", "known_speaker"]
    log = OrderedLog.ranged(
        steps.select(case, seq, *flags, *payload), case, seq, rows_per_chunk=rows_per_chunk, counts_from=counts_from
    )
    limit = max(max_stalls, 1)
    order = log.window()
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    # A step that neither progresses nor leads to a replan by itself is
    # "waiting"; any other step ends the run of stalled steps before it.
    waiting = _stalled() & F.col("known_speaker")
    rows = log.df.withColumns({"_waiting": waiting, "_at": F.row_number().over(order).cast("bigint")})
    rows = rows.withColumn("_restart", F.max(F.when(~F.col("_waiting"), F.col("_at"))).over(before))

    def asks(run: Column) -> Column:
        """Whether a step asks for a replan, as if the case never ended."""
        stall = F.when(_stalled(), run % limit + 1).otherwise(0)
        return ~F.col("is_request_satisfied") & (~F.col("known_speaker") | (stall >= max_stalls))

    run = F.col("_at") - 1 - F.coalesce("_restart", F.lit(0))
    if log.chunks:
        carry = _chunk_carry(log.with_df(rows.withColumn("_asks", asks(run))), limit, max_replans)
        rows = log.with_carry(rows, carry)
        run = F.when(F.col("_restart").isNull(), run + F.coalesce("_run_in", F.lit(0))).otherwise(run)
        asked_in, over_in = F.coalesce("_asked_in", F.lit(0)), F.coalesce("_over_in", F.lit(False))
    else:
        asked_in, over_in = F.lit(0), F.lit(False)

    stall = F.when(_stalled(), run % limit + 1).otherwise(0).cast("bigint")
    rows = (
        rows.withColumns({"_seq": _at_once(log), "_stall": stall, "_asks": asks(run)})
        .withColumn("_asked", asked_in + F.sum(F.col("_asks").cast("bigint")).over(so_far))
        .withColumn("_spent", F.col("_asks") & (F.col("_asked") > max_replans))
        .withColumn("_ends", F.col("is_request_satisfied") | F.col("_spent"))
        .withColumn("_over", over_in | F.coalesce(F.max("_ends").over(before), F.lit(False)))
    )
    over = F.col("_over")
    route = (
        F.when(over, "after_terminal")
        .when(F.col("is_request_satisfied"), "finalize:satisfied")
        .when(F.col("_spent"), "finalize:budget")
        .when(F.col("_asks"), "replan")
        .otherwise("dispatch")
    )
    # A replan starts counting stalls anew; an end keeps the count it ended with.
    stall = F.when(F.col("_asks") & ~F.col("_spent"), 0).otherwise(F.col("_stall"))
    return rows.select(
        case,
        F.col("_seq").alias(seq),
        route.alias("route"),
        F.when(~over, stall).cast("bigint").alias("stall_count"),
        F.when(~over, F.least("_asked", F.lit(max_replans))).cast("bigint").alias("replan_count"),
        *payload,
    )


def replay_summary(trace: DataFrame, case: str = "case_id", seq: str = "seq") -> DataFrame:
    """One row per case from its trace; ``outcome`` is ``open`` while a case has not ended."""
    ended = F.col("route").startswith("finalize")
    return (
        trace.groupBy(case)
        .agg(
            F.count(F.lit(1)).alias("n_steps"),
            F.count_if(F.col("route") == "dispatch").alias("n_dispatched"),
            F.count_if(F.col("route") == "after_terminal").alias("n_after_terminal"),
            F.max("replan_count").alias("replan_count"),
            F.max_by("stall_count", F.when(F.col("stall_count").isNotNull(), F.col(seq))).alias("stall_count"),
            F.max(F.when(ended, F.col("route"))).alias("_outcome"),
            F.max(F.when(ended, F.col(seq))).alias("ended_at"),
        )
        .withColumn("outcome", F.coalesce("_outcome", F.lit("open")))
        .drop("_outcome")
    )


def run_summary(
    summary: DataFrame, answers: DataFrame, transcripts: DataFrame, ledgers: DataFrame, case: str = "case_id"
) -> DataFrame:
    """Per replayed case: its answer or the default, transcript, latest ledger and counters.

    The default stands only for a case without an answer row. ``transcripts``
    are those of ``assemble_transcripts``, ``ledgers`` those of
    ``latest_ledgers``, one row per case each. A case without lines has the
    transcript ``(empty)``, one without a ledger null in its place.
    """
    ledger = ledgers.select(case, F.struct(*[c for c in ledgers.columns if c != case]).alias("task_ledger"))
    given = answers.select(case, "final_answer", F.lit(True).alias("_given"))
    return (
        summary.join(given, case, "left")
        .join(transcripts.select(case, "n_lines", "transcript"), case, "left")
        .join(ledger, case, "left")
        .select(
            case,
            F.when(F.col("_given"), F.col("final_answer")).otherwise(NO_ANSWER).alias("summary"),
            F.coalesce("n_lines", F.lit(0)).alias("n_transcript_rows"),
            F.coalesce("transcript", F.lit(EMPTY)).alias("transcript"),
            "task_ledger",
            "replan_count",
            "stall_count",
            "outcome",
        )
    )


def stall_runs(
    steps: DataFrame, case: str = "case_id", seq: str = "seq", rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Runs of consecutive stalled steps, without replans: ``case, started_at, ended_at, n_stalls``."""
    flags = ["is_in_loop", "is_progress_being_made"]
    log = OrderedLog.ranged(steps.select(case, seq, *flags), case, seq, rows_per_chunk=rows_per_chunk)
    log = log.running_sum("_run", (~_stalled()).cast("bigint"))
    # Grouping is partial first, so a run of any length is cheap.
    return (
        log.result.where(_stalled())
        .groupBy(case, "_run")
        .agg(F.min(seq).alias("started_at"), F.max(seq).alias("ended_at"), F.count(F.lit(1)).alias("n_stalls"))
        .drop("_run")
    )


def repeated_steps(
    steps: DataFrame,
    same: tuple[str, ...] = ("next_speaker", "instruction", "reply"),
    case: str = "case_id",
    seq: str = "seq",
    rows_per_chunk: int = WIDE_ROWS_PER_CHUNK,
) -> DataFrame:
    """Flag steps that repeat the one before in every column of ``same``; nulls are equal."""
    log = OrderedLog.ranged(steps.select(case, seq, *same), case, seq, rows_per_chunk=rows_per_chunk)
    log = log.neighbour({"_seq": seq, **{f"_before_{c}": c for c in same}})
    repeated = F.col("_seq").isNotNull()
    for c in same:
        repeated = repeated & F.col(c).eqNullSafe(F.col(f"_before_{c}"))
    return log.result.select(case, seq, *same, repeated.alias("repeats_previous"))


def with_instruction(route: Column, instruction: Column) -> Column:
    """A dispatch adds transcript rows only when it carries an instruction."""
    return (route == "dispatch") & is_filled(instruction)
