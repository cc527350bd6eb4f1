"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import captures, clusters, conversations, fingerprint, jaccard, language, mixing, neardup, neighbours, packing, pii, quality, revisits, secret_scan, spans
from barloom.llm.common import fold_of, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and how like they and its neighbour's are."""
    found = fingerprint.compare(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates that each document is in."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document and of its source, the source's target, and the words the mix takes."""
    docs = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM per
), ordered AS (
  SELECT *, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE AS stopped,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    (sum(source_size) OVER ())::DOUBLE AS total
  FROM ranked WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), leveled AS (
  SELECT *, (total * 1.5::DOUBLE - stopped) / open_weight AS own_level FROM ordered
), one AS (
  SELECT *, max(CASE WHEN weight * own_level <= source_size * 2.0::DOUBLE THEN own_level END) OVER () AS level FROM leveled
), aims AS (
  SELECT source, source_size, coalesce(least(weight * level, source_size * 2.0::DOUBLE), source_size * 2.0::DOUBLE) AS target FROM one
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS chance
  FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source
)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM rated
"""


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each revisit of a page, resolved."""
    found = revisits.resolve(captures.records_of(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", "canonical_url", "response_id", "status", headers.alias("headers"), F.sha2(F.encode("payload", "UTF-8"), 256).alias("payload_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document; labels of the held-out fold are not used."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 5) != 0)
    found = quality.classify(docs, quality.train(docs, learn))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to every fiftieth."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _digests(found: DataFrame, base: list[str]) -> DataFrame:
    """Counts of base spans by kind, the digest of all base spans, and all spans, of doc_id and spans."""
    counts = [F.size(spans.of_kinds(F.col("spans"), [k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(F.encode(spans.joined(spans.of_kinds(F.col("spans"), base)), "UTF-8"), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, from two scans of which the second finds the first one's blobs in the ledger."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    early = F.coalesce(F.col("path") % 2 != 0, F.lit(False))
    first, ledger = secret_scan.scan(docs.where(early))
    second, _ = secret_scan.scan(docs.where(~early), ledger)
    return _digests(first.unionByName(second).withColumnRenamed("path", "doc_id"), secret_scan.BASE)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document; rows of the held-out fold teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document."""
    return _digests(pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"]), pii.BASE)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector after five rounds, and how tight clusters are."""
    return clusters.summary(*clusters.cluster(table(spark, sf_dir, "embeddings")))


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates by pairs of words that each document is in, and whether it stays."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each damaged conversation, its cheapest repair and what comes of it."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.summary(conversations.repair(conversations.damaged(rows)), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_mix_sources": op3_mix_sources,
    "op4_revisits": op4_revisits,
    "op5_quality": op5_quality,
    "op6_neighbours": op6_neighbours,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_secrets": op8_secrets,
    "op9_language": op9_language,
    "op10_personal_data": op10_personal_data,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_near_duplicates": op12_near_duplicates,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {"op3_mix_sources": OP3_SQL, "op4_revisits": captures.SQL, "op8_secrets": secret_scan.SQL, "op11_centroid_clusters": clusters.SQL}
