"""Resolution of not-modified revisit records in web archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import partitions, settled

#: Headers that a not-modified answer may bring up to date (fixed by HTTP).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Query parameters that don't name content (fixed values).
TRACKING = "^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(?:=|$)"
#: Spans of time that the records of one URL are split into: as many as there are shuffle partitions, within these bounds.
LEAST_SLICES, MOST_SLICES = 64, 512


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, www, default ports, fragment, tracking parameters and closing slash;
    host in lower case, parameters sorted. Null: null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)", 1), "/+$", "")
    parameters = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.array_sort(parameters), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def latest_before(events: DataFrame, key: str, at: str, tie: str, is_source: Column, payload: Column, slices: int | None = None) -> DataFrame:
    """events with `latest`: payload of the last row with is_source of the same key and a smaller `at` (of
    several with one `at`, that with the largest tie); null without one or where key or at is null.

    An as-of join for hot keys: rows are dealt by key and slice of time (of the times' quantiles). Within a slice a
    window finds the latest; where it has none, the last of the slices before it counts, which a window
    over one row for each slice finds.
    """
    slices = slices or min(MOST_SLICES, max(LEAST_SLICES, partitions(events.sparkSession)))
    cuts = sorted(set(events.select(F.col(at).cast("double").alias("at")).approxQuantile("at", [k / slices for k in range(1, slices)], 0.2 / slices)))
    slice_ = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col(at).cast("double"))) if cuts else F.lit(0)
    rows = events.withColumn("_slice", slice_).withColumn("_source", F.coalesce(is_source, F.lit(False)) & F.col(at).isNotNull())
    rows = rows.withColumn("_payload", F.when(F.col("_source"), payload))
    inside = Window.partitionBy(key, "_slice").orderBy(F.col(at), F.col("_source"), F.col(tie)).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.last("_payload", ignorenulls=True).over(inside))
    ends = rows.where("_source").groupBy(key, "_slice").agg(F.max_by("_payload", F.struct(at, tie)).alias("_end"))
    marks = ends.select(key, "_slice", "_end").unionByName(rows.select(key, "_slice").distinct().withColumn("_end", F.lit(None)))
    marks = marks.groupBy(key, "_slice").agg(F.max("_end").alias("_end"))
    across = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = marks.withColumn("_before", F.last("_end", ignorenulls=True).over(across)).select(F.col(key).alias("_key"), F.col("_slice").alias("_of"), "_before")
    joined = near.join(earlier, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_of")), "left")
    latest = F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), F.coalesce("_near", "_before"))
    return joined.withColumn("latest", latest).drop("_slice", "_source", "_payload", "_near", "_key", "_of", "_before")


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Each revisit of records with the body and headers of the response that it stands for.

    records: record_id, url, captured (a number or time), kind (`response` or `revisit`), etag, last_modified,
    headers (map), payload. A revisit refers to the latest strictly earlier response of its canonical URL.
    Entity tags decide where both have one (weak marks aside), else the dates of last modification; `status` is
    `matched`, `changed` (they differ), `unchecked` (no validator on both sides) or `missing` (no such response).
    A payload is returned for matched and unchecked ones; headers are the response's, with those PERMITTED
    of the revisit in their place. Only identifiers and validators are sorted; payloads are joined at the end.

    Returns record_id, canonical_url, response_id, status, headers, payload: a row for each row of kind
    `revisit`. Null url or time: missing. Null headers: none. Repeated revisits: each has its row; responses of
    one record_id count once. Other kinds and columns are ignored.
    """
    light = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured", "kind", "etag", "last_modified", _lower_keys(F.col("headers")).alias("headers")
    )
    is_response = F.col("kind") == "response"
    response = F.struct("record_id", "etag", "last_modified", F.array_sort(F.map_entries("headers")).alias("headers"))
    found = latest_before(light, "canonical_url", "captured", "record_id", is_response, response).where("kind = 'revisit'")
    tags = _weak(F.col("etag")) == _weak(F.col("latest.etag"))
    status = (
        F.when(F.col("latest").isNull(), "missing")
        .when(tags.isNotNull(), F.when(tags, "matched").otherwise("changed"))
        .when((F.col("last_modified") == F.col("latest.last_modified")).isNotNull(), F.when(F.col("last_modified") == F.col("latest.last_modified"), "matched").otherwise("changed"))
        .otherwise("unchecked")
    )
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(F.map_from_entries(F.coalesce("latest.headers", F.array().cast("array<struct<key:string,value:string>>"))), lambda k, _: ~F.array_contains(F.map_keys(update), k))
    revisits = found.select("record_id", "canonical_url", F.col("latest.record_id").alias("response_id"), status.alias("status"), F.map_concat(old, update).alias("headers"))
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("_response"), "payload")
    if not bodies.groupBy("_response").count().where("count > 1").isEmpty():
        bodies = settled(bodies.dropDuplicates(["_response"]), "revisit-bodies")
    # both sides come straight from a shuffle or the table, so Spark can split the revisits of a much visited response
    fits = (F.col("response_id") == F.col("_response")) & F.col("status").isin("matched", "unchecked")
    return revisits.join(bodies, fits, "left").drop("_response")


def _lower_keys(headers: Column) -> Column:
    """The map with keys in lower case, the last of equal keys; null: empty."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    lower = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(lower, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))
