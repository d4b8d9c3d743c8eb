"""Resolution of WARC revisit records of kind not-modified.

Method: an as-of join by canonical URL: each revisit is joined to the latest earlier full response of its
URL, its validators are checked against that response, and the headers that a 304 may change are merged
over the stored ones. The join is done in two levels, so that no URL is gathered in one task: records are dealt by
ranges of URL, time and id, as many rows to each range, and within a range the latest response is carried forward; the last
response of each range, one row for it and a URL, is carried on to the ranges after it.

Only DataFrame functions are used, and payloads are not shuffled: what is joined is their digest.

Defined results: a null URL has the canonical URL '' and is resolved among its like; null times sort before all others;
records of one URL at one time are taken in the order of their ids, so a response counts as earlier than a
revisit of that time if its id is smaller; repeated rows each give a row; names of headers have no case, and come out in lower case, and of a
name that a record has in several cases the last value in the order of these counts; a validator that either side
lacks is not checked, and a revisit without any checked validator counts as unchecked; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Headers of a 304 response that replace the stored ones (RFC 9111, 4.3.4; RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, user, default port, leading www., fragment, tracking parameters and trailing slash; host in lower case."""
    url = F.coalesce(F.trim(url), F.lit(""))
    url = F.regexp_replace(url, r"#.*$", "")
    url = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    query = F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def folded(headers: Column) -> Column:
    """A map with its names in lower case; of names that then are equal, the last in their order counts."""
    entries = F.array_sort(F.map_entries(headers))
    low = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), (~F.array_contains(F.slice(low, i + 2, F.size(low)), F.lower(e["key"]))).alias("last"))), lambda e: e["last"])
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def resolve(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each revisit and response of records (record_id, url, at long, revisit boolean, digest, headers map<string,string>).

    Adds `status` (full, resolved, unchecked, mismatch or missing), `source_id` and `source_digest` (those of the
    response that stands for it; null for mismatch and missing) and `merged` (the headers it then has).
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), "at", F.coalesce("revisit", F.lit(False)).alias("revisit"), "digest", folded(F.col("headers")).alias("headers"))
    # Ranges hold from when they are written: their bounds are drawn from a sample.
    by = (F.col("url"), F.col("at").asc_nulls_first(), F.col("record_id").asc_nulls_first())
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    rows = stored(dealt.withColumn("slice", F.spark_partition_id()))
    response = F.when(~F.col("revisit"), F.struct("record_id", "digest", "headers"))
    within = Window.partitionBy("url", "slice").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last(response, ignorenulls=True).over(within))
    ends = rows.where(~F.col("revisit")).groupBy("url", "slice").agg(F.max(F.struct("at", "record_id", "digest", F.to_json("headers").alias("headers"))).alias("end"))
    slices = rows.groupBy("url", "slice").agg(F.bool_or("revisit").alias("asks")).join(ends, ["url", "slice"], "left")
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("far", F.last("end", ignorenulls=True).over(before)).where("asks").select("url", "slice", "far")
    joined = rows.join(carried, ["url", "slice"], "left")
    far = F.when(F.col("far").isNotNull(), F.struct(F.col("far.record_id").alias("record_id"), F.col("far.digest").alias("digest"), F.from_json("far.headers", "map<string,string>").alias("headers")))
    found = joined.withColumn("prior", F.when(F.col("revisit"), F.coalesce("near", far)))
    same = lambda name: F.coalesce(F.col("headers")[name] == F.col("prior.headers")[name], F.lit(True))
    checked = lambda name: F.coalesce(F.col("headers")[name].isNotNull() & F.col("prior.headers")[name].isNotNull(), F.lit(False))
    status = (
        F.when(~F.col("revisit"), "full")
        .when(F.col("prior").isNull(), "missing")
        .when(~(same("etag") & same("last-modified")), "mismatch")
        .when(checked("etag") | checked("last-modified"), "resolved")
        .otherwise("unchecked")
    )
    found = found.withColumn("status", status)
    stands = F.col("status").isin("resolved", "unchecked")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    allowed = F.map_filter(F.coalesce("headers", empty), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("prior.headers", empty), lambda k, v: ~F.map_contains_key(allowed, k))
    return found.select(
        "record_id", "url", "at", "revisit", "status",
        F.when(F.col("status") == "full", F.col("record_id")).when(stands, F.col("prior.record_id")).alias("source_id"),
        F.when(F.col("status") == "full", F.col("digest")).when(stands, F.col("prior.digest")).alias("source_digest"),
        F.when(stands, F.map_concat(kept, allowed)).otherwise(F.col("headers")).alias("merged"),
    )


#: A page is asked for again this much later.
LAG = 500


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records of pages, whose ids are times.

    Each page gives a full response at its id and a not-modified revisit LAG later; a page whose id leaves 4
    when divided by 5 also gives a revisit of another URL, of which no response was kept. Record ids are four times the
    page's, and 0, 1 or 2. The table has no headers, so they follow from the row, named as servers name them in responses
    and in lower case in revisits: the entity tag is the first part of the URL's path, but for revisits whose page
    id leaves 5 when divided by 7, which ask about another one; all have a date and a server, and a response has its media
    type and length.
    """
    orphan = F.coalesce(F.col("page_id") % 5 == 4, F.lit(False))
    kinds = F.when(orphan, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = pages.select(
        "page_id", "url", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("digest"),
        F.coalesce(F.octet_length("html"), F.lit(0)).cast("string").alias("length"), F.explode(kinds).alias("kind"),
    )
    rows = rows.withColumn("url", F.when(F.col("kind") == 2, F.concat(F.lit("gone.example/"), F.col("page_id"))).otherwise(F.col("url")))
    revisit = F.col("kind") > 0
    tag = F.concat(F.lit('"'), F.regexp_extract(canonical_url(F.col("url")), r"^[^/]*(/[^/?]*)?", 1), F.when(revisit & (F.col("page_id") % 7 == 5), "-new").otherwise(""), F.lit('"'))
    at = F.col("page_id") + F.when(revisit, LAG).otherwise(0)
    date = F.coalesce(at.cast("string"), F.lit(""))
    asked = F.create_map(F.lit("etag"), tag, F.lit("date"), date, F.lit("server"), F.lit("edge"))
    full = F.create_map(F.lit("ETag"), tag, F.lit("Date"), date, F.lit("Server"), F.lit("origin"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("length"))
    return rows.select((F.col("page_id") * 4 + F.col("kind")).alias("record_id"), "url", at.alias("at"), revisit.alias("revisit"), "digest", F.when(revisit, asked).otherwise(full).alias("headers"))


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve(page_records(table(spark, sf_dir, "pages")))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    return done.select("record_id", "url", "status", "source_id", "source_digest", entries.alias("merged_headers"))


OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, html, regexp_replace(regexp_replace(coalesce(trim(url), ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*@)?', '') AS u FROM pages
), parts AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    regexp_replace(regexp_replace(regexp_extract(u, '\?(.*)$', 1), '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS query FROM cut
), urls AS (
  SELECT page_id, html, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url FROM parts
), records AS (
  SELECT page_id * 4 + kind AS record_id, page_id + CASE WHEN kind > 0 THEN 500 ELSE 0 END AS ts, url, kind > 0 AS revisit, sha256(coalesce(html, '')) AS digest, coalesce(strlen(html), 0) AS len,
    '"' || regexp_extract(url, '^[^/]*(/[^/?]*)?', 1) || CASE WHEN kind > 0 AND page_id % 7 = 5 THEN '-new' ELSE '' END || '"' AS etag
  FROM (SELECT page_id, html, kind, CASE WHEN kind = 2 THEN 'gone.example/' || page_id ELSE url END AS url FROM urls, (VALUES (0), (1), (2)) k(kind) WHERE kind < 2 OR page_id % 5 = 4)
), latest AS (
  SELECT *, max(CASE WHEN revisit THEN NULL ELSE {'t': ts, 'id': record_id} END)
    OVER (PARTITION BY url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM records
), joined AS (
  SELECT r.*, p.record_id AS pid, p.digest AS pdigest, p.etag AS petag, p.len AS plen
  FROM latest r LEFT JOIN records p ON r.prior.id = p.record_id
), judged AS (
  SELECT *, CASE WHEN NOT revisit THEN 'full' WHEN pid IS NULL THEN 'missing' WHEN etag <> petag THEN 'mismatch' ELSE 'resolved' END AS status FROM joined
)
SELECT record_id, url, status,
  CASE status WHEN 'full' THEN record_id WHEN 'resolved' THEN pid END AS source_id,
  CASE status WHEN 'full' THEN digest WHEN 'resolved' THEN pdigest END AS source_digest,
  CASE WHEN status = 'full' THEN 'content-length=' || len || '; content-type=text/html; date=' || ts || '; etag=' || etag || '; server=origin'
    WHEN status = 'resolved' THEN 'content-length=' || plen || '; content-type=text/html; date=' || ts || '; etag=' || etag || '; server=origin'
    ELSE 'date=' || ts || '; etag=' || etag || '; server=edge' END AS merged_headers
FROM judged
"""
