"""A corpus from raw documents to token ids: stages over the documents table.

Each stage takes the documents that its predecessor kept. All but the last
return the columns of documents; the last adds token ids and the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casework.llm import bagminhash, bpe, decontam, secret_scan, toxicity
from casework.llm.common import quoted, stage
from casework.session import ship_package
from casework.sources.tables import read_table

ship_package()

# No SQL here: scores, signatures and token ids are not SQL expressions.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column], dict[str, str]]:
    """``docs`` with all columns but id and text under names that no operator
    uses, the columns that bring the names back, and the new name of each."""
    names = {c: c if c in ("doc_id", "text") else f"_own{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[quoted(c).alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()], names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted to the labels of these documents, does not reject."""
    held, back, _ = _apart(docs)
    model = toxicity.fit(held.select("doc_id", "text"), read_table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(held, model).where("predicted = 0").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    held, back, _ = _apart(docs)
    return bagminhash.drop_copies(held).select(*back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    held, back, _ = _apart(docs)
    found = decontam.leaks(held, read_table(spark, sf_dir, "benchmark"))
    return found.where(~decontam.contaminated()).select(*back)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text."""
    held, back, names = _apart(docs)
    found = secret_scan.find(held)
    hit = F.size("spans") > 0
    masked = F.when(hit, secret_scan.redact(F.coalesce("text", F.lit("")), F.col("spans"))).otherwise(F.col("text"))
    out = found.withColumn("_masked", masked)
    length = F.when(hit, F.length("_masked")).otherwise(F.col(names["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return out.withColumn(names["n_chars"], length).withColumn("text", F.col("_masked")).select(*back)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and a check that they decode to it."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared space."""
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
