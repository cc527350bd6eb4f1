"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import settled

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to so many go to all executors; beyond it, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, rate of each source of sizes (source, size).

    Sources by code point, null last, weigh `weights`, repeating. They share `share` times the
    total; a target stops at `most` times its source's size and the excess goes to the others by
    weight, until none is above. That is one level for all: target = min(weight * level, most * size);
    in order of size / weight, the sources before a point are those that stop.
    Works on one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    ordered = per.withColumn("weight", weight)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = (
        ordered.withColumn("stopped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most)))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("stopped")) / F.col("open_weight"))
        .withColumn("level", F.max(F.when(F.col("weight") * F.col("level") <= F.col("source_size") * F.lit(float(most)), F.col("level"))).over(everything))
    )
    limit = F.col("source_size") * F.lit(float(most))
    target = F.coalesce(F.least(F.col("weight") * F.col("level"), limit), limit)
    return ordered.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def with_copies(docs: DataFrame, seed: str = "mix", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs (doc_id, text, source) with mix_size (words), mix_source_size, mix_target and mix_copies.

    A document has floor(rate) copies and one more with probability rate - floor(rate), decided by
    a hash of seed and doc_id: reruns agree, and rows of one doc_id are decided alike. Null text: size 0.
    Null source: a source of its own. Null doc_id: hashed as the text 'null'. No rows: none. Copies
    need no shuffle of texts: sources are aggregated, and joined back to the rows.
    """
    sized = docs.withColumn("mix_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    aims = targets(sized.select("source", F.col("mix_size").alias("size")), weights, share, most).select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate")
    )
    aims = settled(aims, "mix-targets")
    if aims.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        aims = F.broadcast(aims)
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    whole = F.floor("mix_rate")
    copies = whole + (chance < F.col("mix_rate") - whole).cast("long")
    return sized.join(aims, F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("mix_copies", copies).drop("mix_source", "mix_rate")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of docs as often as with_copies() says, with the columns of docs, whatever their names."""
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    counted = with_copies(rows, **options).where("mix_copies > 0")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    return counted.select("row", copy.alias("mix_copy")).select("row.*")
