"""Score chat requests in bulk with a model function the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import is_filled
from .prompts import clean_answer
from .skew import lookup, row_hash

# Parts that resumable scoring asks for one after another.
SLICES = 8

# One model: a list of requests (each a list of role/content dicts) to replies.
Model = Callable[[list[list[dict]]], list[str]]
ModelFactory = Callable[[str], Model]


def _reply_one_by_one(model: Model, requests: list[list[dict]]) -> tuple[list, list]:
    """After a failed batch, so that one bad request does not take the others along."""
    replies, errors = [], []
    for request in requests:
        try:
            replies.append(model([request])[0])
            errors.append(None)
        except Exception as exc:  # noqa: BLE001 - a model may fail in any way; the row records it
            replies.append(None)
            errors.append(f"{type(exc).__name__}: {exc}")
    return replies, errors


def score(requests: DataFrame, factory: ModelFactory, partitions: int | None = None) -> DataFrame:
    """Add ``reply`` and ``error`` to rows with ``model_id`` and ``messages``.

    A task makes each model it meets once and sends it whole Arrow batches. By
    default rows stay where they are; with ``partitions`` they are spread by
    row hash, never by model, so a model with most of the requests still uses
    every task.
    """
    if partitions:
        requests = requests.repartition(partitions, row_hash(requests))
    schema = T.StructType(
        [
            *requests.schema.fields,
            T.StructField("reply", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, Model] = {}
        for batch in batches:
            batch["reply"], batch["error"] = None, None
            for model_id, rows in batch.groupby("model_id", sort=False, dropna=False):
                asked = [[dict(m) for m in request] for request in rows["messages"]]
                try:
                    if model_id not in models:
                        models[model_id] = factory(model_id)
                    replies = list(models[model_id](asked))
                    if len(replies) != len(asked):
                        raise ValueError(f"{len(replies)} replies to {len(asked)} requests")
                    errors = [None] * len(asked)
                except Exception as exc:  # noqa: BLE001
                    if model_id in models:
                        replies, errors = _reply_one_by_one(models[model_id], asked)
                    else:
                        replies, errors = [None] * len(asked), [f"{type(exc).__name__}: {exc}"] * len(asked)
                batch.loc[rows.index, "reply"] = pd.Series(replies, index=rows.index, dtype="object")
                batch.loc[rows.index, "error"] = pd.Series(errors, index=rows.index, dtype="object")
            yield batch

    return requests.mapInPandas(run, schema)


def score_once(
    requests: DataFrame, factory: ModelFactory, ledger: str, slices: int = SLICES, partitions: int | None = None
) -> DataFrame:
    """``score`` with a ledger of replies in the folder ``ledger``, shared by all runs that name it.

    Requests are told apart by a hash of ``model_id`` and ``messages``. Equal
    ones are asked once, and none that the ledger has a reply for; one that
    failed is asked again by the next run. Requests go in ``slices`` by their
    hash, and each is in the ledger before the next begins, so a failed job
    loses the replies of one slice. Asking happens here; what is returned
    reads the ledger and calls no model.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("_request", F.sha2(F.to_json(F.struct("model_id", "messages"), {"ignoreNullFields": "false"}), 256))
    # One row stands for all equal requests; partial aggregation drops the others before the shuffle.
    asked = keyed.groupBy("_request").agg(F.first("model_id").alias("model_id"), F.first("messages").alias("messages"))
    row = T.StructType([T.StructField(c, T.StringType()) for c in ("_request", "reply", "error")])
    known = spark.createDataFrame([], row).write.mode("append")
    known.parquet(ledger)
    for i in range(slices):
        done = spark.read.schema(row).parquet(ledger).where("error is null").select("_request")
        mine = asked.where(F.pmod(F.crc32(F.col("_request").cast("binary")), F.lit(slices)) == i)
        todo = mine.join(done.where(F.pmod(F.crc32(F.col("_request").cast("binary")), F.lit(slices)) == i), "_request", "left_anti")
        score(todo, factory, partitions).select(*row.names).write.mode("append").parquet(ledger)
    replies = spark.read.schema(row).parquet(ledger)
    # A reply counts before an error of an earlier run.
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "error", "reply")).alias("_best")
    replies = replies.groupBy("_request").agg(best).select("_request", "_best.reply", "_best.error")
    return lookup(keyed, replies, "_request").drop("_request").select(*requests.columns, "reply", "error")


def final_answers(
    cases: DataFrame, factory: ModelFactory, answer: str = "final_answer", partitions: int | None = None
) -> DataFrame:
    """Keep given answers; ask the model only for cases without one, and strip its reply.

    ``cases`` holds ``answer``, ``model_id`` and ``messages``. The split comes
    before the scorer, as no filter is pushed through it. A failed request
    leaves a null answer and its ``error``.
    """
    kept = [c for c in cases.columns if c not in ("model_id", "messages")]
    no_error = F.lit(None).cast("string").alias("error")
    given = cases.where(is_filled(answer)).select(*kept, F.lit("given").alias("origin"), no_error)
    asked = score(cases.where(~is_filled(answer)), factory, partitions)
    others = [c for c in kept if c != answer]
    made = asked.select(*others, clean_answer("reply").alias(answer), F.lit("model").alias("origin"), "error")
    return given.unionByName(made)
