"""Resolution of not-modified revisits in web archives (DataFrame functions only).

A revisit record says that a page had not changed; its content is in the latest earlier full response for the same canonical URL. The as-of
join works on distinct (URL, time) pairs in blocks of time that hold about as many pairs each (Spark's range partitions of a sample): within a block the latest response before each time comes from a window, across
blocks from the last response of the latest earlier block. A URL with very many captures is thus spread over all blocks, and a block's
share of it is all that one task sees. Payloads stay where they are; a resolved revisit names the response record and its payload digest.

The response found is accepted if its validators agree with the revisit's: entity tags (weak comparison) if both have one, else
Last-Modified if both have one, else payload digests. Header fields of the 304 replace those of the stored response, except hop-by-hop
fields, those named in its Connection field, and those that describe a body that a 304 doesn't have.

Records: record_id, url, ts (any orderable integer), kind ('response' or 'revisit'), headers (a block of `Name: value` lines), digest
(of the payload, null if unknown); other columns are not read. A response counts only if its kind is 'response'.

Defined results, in `status`: 'resolved'; 'mismatch' (validators differ); 'unverifiable' (nothing to compare); 'no_response' (no earlier response);
'no_url' (URL null or not absolute); 'no_time' (ts null). A response at the revisit's own time is not earlier. Of responses at one time the largest
record_id counts. Lines without a colon are left out; repeated fields keep their order. Repeated revisit rows are resolved one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

#: Rows of distinct (URL, time) in a block of time.
BLOCK_ROWS = 20_000
#: Blocks of time, at most; beyond it they hold more rows, and a URL's share of one is still all that a task must sort.
MOST_BLOCKS = 20_000
#: RFC 9111, sections 3.1 and 3.2: not taken from a 304.
NOT_MERGED = ("connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type")
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column) -> Column:
    """Host and path alike for http and https, lower-case host without www. and default port, no fragment, no closing slash, query fields
    sorted without those of campaigns (utm_...). Null if not absolute."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), r"^[^@]*@", ""), r":(?:80|443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 3), r"/+$", "")
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(url, _URL, 4), "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))))
    query = F.array_join(fields, "&")
    return F.when(url.rlike(_URL) & (host != ""), F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def fields(block: Column) -> Column:
    """A header block as an array of (name in lower case, value)."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[^:\s]+\s*:"))
    return F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))


def field(pairs: Column, name: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["name"] == name), F.lit(0))["value"]


def merged_fields(old: Column, new: Column) -> Column:
    named = F.transform(F.split(F.lower(F.coalesce(field(new, "connection"), F.lit(""))), ","), lambda x: F.trim(x))
    taken = F.filter(new, lambda p: ~p["name"].isin(*NOT_MERGED) & ~F.array_contains(named, p["name"]))
    names = F.transform(taken, lambda p: p["name"])
    return F.concat(F.filter(old, lambda p: ~F.array_contains(names, p["name"])), taken)


def resolve_revisits(records: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per revisit record: record_id, url, ts, canonical_url, refers_to, refers_ts, digest, headers (merged pairs), status."""
    kept = Written(records.sparkSession, "warc")
    base = records.select("record_id", "url", "ts", "kind", "headers", "digest", canonical_url(F.col("url")).alias("key"))
    known = F.col("key").isNotNull() & F.col("ts").isNotNull()
    full = base.where(known & (F.col("kind") == "response"))
    full = full.groupBy("key", "ts").agg(F.max("record_id").alias("response"))
    times = base.where(known & (F.col("kind") == "revisit")).select("key", "ts", F.lit(None).cast(base.schema["record_id"].dataType).alias("response"), F.lit(1).alias("asked")).distinct()
    spots = full.withColumn("asked", F.lit(0)).unionByName(times).groupBy("key", "ts").agg(F.max("response").alias("response"), F.max("asked").alias("asked"))
    spots = kept.table(spots)
    blocks = max(1, min(MOST_BLOCKS, -(-spots.count() // block_rows)))
    spots = kept.table(spots.repartitionByRange(blocks, "ts").withColumn("block", F.spark_partition_id()))
    own = F.when(F.col("response").isNotNull(), F.struct(F.col("response").alias("id"), F.col("ts").alias("ts")))
    before = F.last(own, ignorenulls=True).over(Window.partitionBy("key", "block").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    inside = spots.withColumn("before", before).where("asked = 1").select("key", "ts", "block", "before")
    ends = spots.groupBy("key", "block").agg(F.max(F.when(F.col("response").isNotNull(), F.struct("ts", F.col("response").alias("id")))).alias("end"))
    carried = F.last("end", ignorenulls=True).over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("carried", carried).select("key", "block", F.struct(F.col("carried.id").alias("id"), F.col("carried.ts").alias("ts")).alias("carried"))
    found = inside.join(ends, ["key", "block"]).select("key", "ts", F.coalesce("before.id", "carried.id").alias("refers_to"), F.coalesce("before.ts", "carried.ts").alias("refers_ts"))
    found = kept.table(found.where("refers_to IS NOT NULL"))
    meta = base.where(known & (F.col("kind") == "response")).select(F.col("key"), F.col("ts").alias("refers_ts"), F.col("record_id").alias("refers_to"), F.col("headers").alias("old_headers"), F.col("digest").alias("old_digest"))
    meta = meta.join(found.select("key", "refers_ts", "refers_to").distinct(), ["key", "refers_ts", "refers_to"], "left_semi").dropDuplicates(["key", "refers_ts", "refers_to"])
    found = found.join(meta, ["key", "refers_ts", "refers_to"])
    out = base.where("kind = 'revisit'").join(found, ["key", "ts"], "left")
    old, new = fields(F.col("old_headers")), fields(F.col("headers"))
    tag = lambda pairs: F.regexp_replace(field(pairs, "etag"), r"^[Ww]/", "")
    agree = F.coalesce(tag(old) == tag(new), field(old, "last-modified") == field(new, "last-modified"), F.col("old_digest") == F.col("digest"))
    status = F.when(F.col("ts").isNull(), "no_time").when(F.col("key").isNull(), "no_url").when(F.col("refers_to").isNull(), "no_response").when(agree.isNull(), "unverifiable").when(agree, "resolved").otherwise("mismatch")
    out = out.withColumn("status", status)
    good = F.col("status") == "resolved"
    return out.select(
        "record_id", "url", "ts", F.col("key").alias("canonical_url"), "refers_to", "refers_ts",
        F.when(good, F.col("old_digest")).alias("digest"), F.when(good, merged_fields(old, new)).alias("headers"), "status",
    )


def page_records(pages: DataFrame) -> DataFrame:
    """A capture log of `pages`. Each page is a full response (r) at time 2 * page_id, every third once more (s) 12 pages later. A revisit (v) of each
    comes from 20 pages before to 40 after the response, at an odd time or, of some, at the response's own; some have no time, no URL or a relative
    one. By page_id modulo 5: both have the same entity tag; both Last-Modified; neither, so that digests decide; tags that differ; nothing and no
    digest on the revisit."""
    n, tag = F.col("page_id"), F.md5("html")
    way = n % 5
    stamp = F.concat(F.lit("stamp "), n)
    validators = lambda tag, mark: F.when(way.isin(0, 3), F.concat(F.lit(f'ETag: {mark}"'), tag, F.lit('"\r\n'))).when(way == 1, F.concat(F.lit("Last-Modified: "), stamp, F.lit("\r\n"))).otherwise("")

    def full(name: str, later: int, which: Column) -> DataFrame:
        return pages.where(which).select(
            F.concat(F.lit(name), n).alias("record_id"), "url", ((n + later) * 2).alias("ts"), F.lit("response").alias("kind"),
            F.concat(F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length("html"), F.lit("\r\n"), validators(tag, ""), F.lit("Cache-Control: max-age=60\r\nX-Page: "), F.lit(name), n).alias("headers"),
            F.sha2("html", 256).alias("digest"),
        )

    time = F.when(n % 17 == 5, None).when(n % 11 == 3, n * 2).otherwise((n + n * 7919 % 61 - 20) * 2 + 1)
    again = pages.select(
        F.concat(F.lit("v"), n).alias("record_id"), F.when(n % 19 == 6, None).when(n % 19 == 7, "/relative").otherwise(F.col("url")).alias("url"), time.alias("ts"), F.lit("revisit").alias("kind"),
        F.concat(validators(F.when(way == 3, F.md5(F.concat("html", F.lit("x")))).otherwise(tag), "W/"), F.lit("Content-Length: 0\r\nConnection: close, X-Hop\r\nX-Hop: 1\r\nCache-Control: max-age=600")).alias("headers"),
        F.when(way != 4, F.sha2("html", 256)).alias("digest"),
    )
    return full("r", 0, F.lit(True)).unionByName(full("s", 12, n % 3 == 0)).unionByName(again)


_FORM = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
ORACLE_SQL = rf"""
WITH parts AS (
  SELECT page_id, html, url,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '{_FORM}', 2)), '^[^@]*@', ''), ':(?:80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(url, '{_FORM}', 3), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '{_FORM}', 4), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS query
  FROM pages
), named AS (
  SELECT page_id, page_id % 5 AS way, md5(html) AS tag, md5(html || 'x') AS other, sha256(html) AS digest, strlen(html) AS size, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS key
  FROM parts
), asked AS (
  SELECT 'v' || page_id AS record_id, way, CASE WHEN page_id % 19 NOT IN (6, 7) THEN key END AS key,
         CASE WHEN page_id % 17 = 5 THEN NULL WHEN page_id % 11 = 3 THEN page_id * 2 ELSE (page_id + page_id * 7919 % 61 - 20) * 2 + 1 END AS ts,
         CASE way WHEN 0 THEN tag WHEN 3 THEN other END AS tag, CASE way WHEN 1 THEN 'stamp ' || page_id END AS stamp, CASE WHEN way <> 4 THEN digest END AS digest
  FROM named
), every AS (
  SELECT 'r' || page_id AS record_id, page_id * 2 AS ts, * EXCLUDE (page_id, other), page_id FROM named
  UNION ALL SELECT 's' || page_id, (page_id + 12) * 2, * EXCLUDE (page_id, other), page_id FROM named WHERE page_id % 3 = 0
), held AS (
  SELECT record_id, ts, key, CASE WHEN way IN (0, 3) THEN tag END AS tag, CASE way WHEN 1 THEN 'stamp ' || page_id END AS stamp, digest, size
  FROM every QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY record_id DESC) = 1
), met AS (
  SELECT a.*, h.record_id AS refers_to, h.ts AS refers_ts, h.tag AS old_tag, h.stamp AS old_stamp, h.digest AS old_digest, h.size, coalesce(h.tag = a.tag, h.stamp = a.stamp, h.digest = a.digest) AS agree
  FROM asked a ASOF LEFT JOIN held h ON a.key = h.key AND a.ts > h.ts
)
SELECT record_id, ts, key AS canonical_url, refers_to, refers_ts,
       CASE WHEN ts IS NULL THEN 'no_time' WHEN key IS NULL THEN 'no_url' WHEN refers_to IS NULL THEN 'no_response' WHEN agree IS NULL THEN 'unverifiable' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS status,
       CASE WHEN agree THEN old_digest END AS digest,
       CASE WHEN agree THEN array_to_string(list_filter([
         'content-type: text/html', 'content-length: ' || size, CASE WHEN tag IS NULL THEN 'etag: "' || old_tag || '"' END, CASE WHEN stamp IS NULL THEN 'last-modified: ' || old_stamp END, 'x-page: ' || refers_to,
         'etag: W/"' || tag || '"', 'last-modified: ' || stamp, 'cache-control: max-age=600'], lambda x: x IS NOT NULL), chr(10)) END AS headers
FROM met
"""
