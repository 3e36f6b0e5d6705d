"""The queries of this subpackage and, where SQL can express them, their twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import run_dir
from ..sources.tables import read_table
from . import bagminhash, bpe, decontam, nndescent, periodic, pii, secret_scan, sharding, spelling, substrings, toxicity, trie_counts, warc

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.leaks(docs, read_table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_distinct(F.transform("leaks", lambda x: x["item"])), ",")
    return found.select("doc_id", F.size("leaks").alias("n_passages"), items.alias("items"), decontam.contaminated().alias("contaminated"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    strong = F.col("strong")
    return found.select(
        "doc_id",
        *[secret_scan.count(strong, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.told(strong), 256).alias("base_sha256"),
        secret_scan.told(F.col("spans")).alias("spans"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.read_ranks(BPE_RANKS)
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"))


def op6_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, payloads=False).drop("target_uri")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return trie_counts.count_tokens(docs, trie_counts.read_pieces(PIECES)).drop("text")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law")
    )
    placed = sharding.assign(docs, ["doc_id", "text_crc32", "size"])
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Longest runs first: what is too short for a word stays too short without a code point.
    docs = read_table(spark, sf_dir, "documents")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z\u00C0-\u00FF]{6,}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    cut = F.when(F.col("h") % 199 == 0, F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")).otherwise(F.col("run"))
    counts = runs.select(cut.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return spelling.variants(counts.where("n >= 5 and length(word) >= 6"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[pii.count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"),
        pii.told(F.col("spans")).alias("spans"),
    )


def _looped(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document with the words from one place on made periodic."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def rewritten(held: Column) -> Column:
        n, w, g = F.size(held["w"]), held["w"], F.floor(held["h"] / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        looped = F.transform(w, lambda word, i: F.when(i < a, word).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
        return F.array_join(looped, " ")

    return F.when(h % 10 == 0, F.get(F.transform(F.array(F.struct(words.alias("w"), h.alias("h"))), rewritten), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", _looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.find_runs(docs).drop("text")
    longer = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    told = found.withColumn("best", longer)
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_secret_scan": op3_secret_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_embedding_near_dups": op6_embedding_near_dups,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_sharding": op10_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_personal_data": op12_personal_data,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}
_BITS = "list_transform(range(1, 41), lambda i: format('{:04b}', instr('0123456789abcdef', substr(h, i::INTEGER, 1)) - 1))"

ORACLES: dict[str, str] = {
    "op5_substring_dedup": r"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20)),
        again AS (
            SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at FROM again),
        places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM split),
        kept AS (
            SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.at) AS t
            FROM places p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.at = c.at GROUP BY p.doc_id)
        SELECT s.doc_id, len(s.w) AS n_words, len(s.w) - coalesce(k.n, 0) AS n_removed,
               sha256(coalesce(k.t, '')) AS kept_sha256
        FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id""",
    "op6_embedding_near_dups": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reached AS (
            SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
        SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links,
               min(r.b) AS component_id, min(r.b) = v.vec_id AS kept
        FROM v JOIN reached r ON r.a = v.vec_id GROUP BY v.vec_id""",
    "op7_warc": f"""
        WITH hashed AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        bits AS (SELECT page_id, n, array_to_string({_BITS}, '') AS b FROM hashed),
        coded AS (
            SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5),
                    lambda j: (1 << (4 - j)::INTEGER) * substr(b, (5 * i + j + 1)::INTEGER, 1)::INTEGER))::INTEGER, 1)), '') AS d
            FROM bits),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM coded)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM firsts""",
}
