"""Archive records made of the table of pages, and SQL for their resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records_of(pages: DataFrame) -> DataFrame:
    """Two captures of each page: a full response when its number comes up, and a revisit some steps later.

    Of five revisits in a row, one has an entity tag that nothing has, one has no tag but a date, one has neither.
    """
    number = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    changed = F.concat(F.lit("day "), (number % 365).cast("string"))
    response = pages.select(
        (number * 2).alias("record_id"), "url", (number * 10).alias("captured"), F.lit("response").alias("kind"), tag.alias("etag"), changed.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), (number * 10).cast("string"), F.lit("Server"), F.lit("one")).alias("headers"), F.col("html").alias("payload"),
    )
    revisit = pages.select(
        (number * 2 + 1).alias("record_id"), "url", (number * 10 + 5 + number % 97).alias("captured"), F.lit("revisit").alias("kind"),
        F.when(number % 5 == 0, F.lit('"none"')).when(number % 5 < 3, F.concat(F.lit("W/"), tag)).alias("etag"), F.when(number % 5 != 4, changed).alias("last_modified"),
        F.create_map(F.lit("date"), (number * 10 + 5 + number % 97).cast("string"), F.lit("server"), F.lit("two"), F.lit("Expires"), F.lit("never")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


SQL = r"""
WITH cut AS (
  SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages
), parts AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)), ':(?:80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(?:=|$)'))), '&') AS query
  FROM cut
), named AS (
  SELECT page_id, html, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url,
    '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || (page_id % 365) AS changed FROM parts
), records AS (
  SELECT page_id * 2 AS record_id, canonical_url, page_id * 10 AS captured, 1 AS full_one, tag AS etag, changed AS last_modified, html FROM named
  UNION ALL
  SELECT page_id * 2 + 1, canonical_url, page_id * 10 + 5 + page_id % 97, 0,
    CASE WHEN page_id % 5 = 0 THEN '"none"' WHEN page_id % 5 < 3 THEN tag END, CASE WHEN page_id % 5 <> 4 THEN changed END, NULL FROM named
), found AS (
  SELECT *, last_value(CASE WHEN full_one = 1 THEN {'id': record_id, 'etag': etag, 'last_modified': last_modified, 'html': html} END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY captured, full_one, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM records
), judged AS (
  SELECT *, CASE WHEN r IS NULL THEN 'missing'
    WHEN etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN etag = r.etag THEN 'matched' ELSE 'changed' END
    WHEN last_modified IS NOT NULL AND r.last_modified IS NOT NULL THEN CASE WHEN last_modified = r.last_modified THEN 'matched' ELSE 'changed' END
    ELSE 'unchecked' END AS status
  FROM found WHERE full_one = 0
)
SELECT record_id, canonical_url, r.id AS response_id, status,
  CASE WHEN r IS NULL THEN '' ELSE 'content-type=text/html;' END || 'date=' || captured || ';expires=never' || CASE WHEN r IS NULL THEN '' ELSE ';server=one' END AS headers,
  CASE WHEN status IN ('matched', 'unchecked') THEN sha256(r.html) END AS payload_sha256
FROM judged
"""
