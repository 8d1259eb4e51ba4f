"""Not-modified revisit records resolved by an as-of join on the canonical URL.

Every revisit (a 304 capture without body) takes the latest earlier full response (2xx with the
whole body) of its canonical URL. Records are dealt into ranges of (URL, time, kind, id), so a URL
that holds a third of all captures fills several tasks. Inside a range a window carries the last
full response forward; a range that starts within a URL gets the last full response of the
ranges before it (at most two URLs of a range continue elsewhere: that bounds what is broadcast).

Validators: with an ETag on both sides these must agree (weak comparison), else with a
Last-Modified on both sides these must be equal; then the outcome is ``resolved``, ``unverified``
if no pair can be compared, ``mismatch`` if they differ (no headers are merged). A resolved or
unverified revisit has the response's headers, with those that a 304 may update taken from it.

Defined results: records without a usable URL, time or id are returned as ``no_key``; a response
at the same time is not earlier; of responses at one time the largest id counts; null headers are
empty and names are compared in lower case (the first of two that clash is used); repeated
records are resolved each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from attrition.llm.common import written
from attrition.session import ship_package

# FIXED VALUES: header fields that a 304 response may update (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
# FIXED VALUES: query parameters that only track the visitor.
TRACKING = ("utm_", "gclid", "fbclid", "sessionid")


def canonical(url: str | None) -> str | None:
    """Host and path with sorted parameters: no scheme, "www.", default port, fragment or tracking; None if there is no host."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return None
    if not host:
        return None
    host = host.removeprefix("www.") + (f":{port}" if port not in (None, 80, 443) else "")
    query = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not k.lower().startswith(TRACKING))
    return host + (u.path or "/") + ("?" + urlencode(query, errors="surrogatepass") if query else "")


def canonical_series(urls: pd.Series) -> pd.Series:
    return urls.map(canonical)


def lower_names(headers):
    names = F.transform(F.map_keys(headers), F.lower)
    kept = F.array_distinct(names)
    return F.coalesce(F.map_from_arrays(kept, F.transform(kept, lambda n: F.element_at(F.map_values(headers), F.array_position(names, n).cast("int")))),
                      F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame) -> DataFrame:
    """``records``: (record_id long, url, ts timestamp, status int, headers map, payload_digest). Returns every record as
    (record_id, canonical_url, ts, kind, outcome, response_id, payload_digest, headers)."""
    ship_package(records.sparkSession)
    full = F.col("status").between(200, 299) & (F.col("status") != 206)
    rows = records.select(F.col("record_id").cast("long").alias("record_id"), F.pandas_udf(canonical_series, "string")(F.col("url").cast("string")).alias("curl"), "ts",
                          F.when(F.col("status") == 304, "revisit").when(full, "full").otherwise("other").alias("kind"), lower_names(F.col("headers")).alias("headers"), "payload_digest")
    usable = F.col("curl").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    late = F.when(F.col("kind") == "revisit", 0).otherwise(1)  # a response at the same time comes after
    dealt = rows.withColumn("late", late).withColumn("usable", usable)
    keys = ["curl", "ts", "late", "record_id"]
    ranged = written(dealt.where("usable").drop("usable").repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "captures")

    response = F.when(F.col("kind") == "full", F.struct("ts", "record_id", "payload_digest", F.map_entries("headers").alias("headers")))
    by_part = ranged.groupBy("part", "curl").agg(F.max(response).alias("own"))
    spread = ranged.groupBy("curl").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("curl")
    before = Window.partitionBy("curl").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_part.join(spread, "curl").withColumn("carried", F.last("own", ignorenulls=True).over(before)).where("carried is not null").select(
        F.col("part").alias("p"), F.col("curl").alias("c"), "carried")
    inside = Window.partitionBy("part", "curl").orderBy("ts", "late", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = (ranged.withColumn("own", F.last(response, ignorenulls=True).over(inside))
             .join(F.broadcast(written(carried, "carried")), (F.col("part") == F.col("p")) & (F.col("curl") == F.col("c")), "left")
             .withColumn("r", F.coalesce("own", "carried")))

    old = F.map_from_entries("r.headers")

    def pair(name):
        return F.element_at("headers", name), F.element_at(old, name)

    def strong(tag):
        return F.regexp_replace(tag, "^W/", "")

    (tag, old_tag), (when, old_when) = pair("etag"), pair("last-modified")
    agrees = F.when(tag.isNotNull() & old_tag.isNotNull(), strong(tag) == strong(old_tag)).when(when.isNotNull() & old_when.isNotNull(), when == old_when)
    outcome = (F.when(F.col("kind") != "revisit", F.col("kind")).when(F.col("r").isNull(), "no_response")
               .when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch"))
    update = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    took = F.col("outcome").isin("resolved", "unverified")
    done = found.withColumn("outcome", outcome).select(
        "record_id", F.col("curl").alias("canonical_url"), "ts", "kind", "outcome", F.when(F.col("kind") == "revisit", F.col("r.record_id")).alias("response_id"),
        F.when(took, F.col("r.payload_digest")).when(F.col("kind") != "revisit", F.col("payload_digest")).alias("payload_digest"),
        F.when(took, merged).otherwise(F.col("headers")).alias("headers"))
    rest = dealt.where("not usable").select("record_id", F.col("curl").alias("canonical_url"), "ts", "kind", F.lit("no_key").alias("outcome"), F.lit(None).cast("long").alias("response_id"), "payload_digest", "headers")
    return done.unionByName(rest)


def captures(pages: DataFrame) -> DataFrame:
    """Stand-in crawl records in the schema of ``resolve``: each page as a full response, and a later or earlier revisit of its URL."""
    h = F.pmod(F.xxhash64("page_id"), F.lit(1_000_000))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.date_format(F.timestamp_seconds(1_500_000_000 + h), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    p = pages.select("page_id", "url", "html", h.alias("h"), tag.alias("tag"), day.alias("day"), F.pmod(F.xxhash64("page_id", F.lit(1)), F.lit(10)).alias("form"), F.pmod(F.xxhash64("page_id", F.lit(2)), F.lit(700_000)).alias("wait"))

    def headers(*pairs):
        return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))

    def stamp(seconds):
        return F.date_format(F.timestamp_seconds(seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")

    first, again = 1_600_000_000 + F.col("h"), 1_599_900_000 + F.col("h") + F.col("wait")
    responses = p.select((F.col("page_id") * 2).alias("record_id"), "url", F.timestamp_seconds(first).alias("ts"), F.lit(200).alias("status"),
                         headers(("Content-Type", F.lit("text/html")), ("ETag", F.when(F.col("form") != 3, F.col("tag"))), ("Last-Modified", F.col("day")), ("Date", stamp(first)), ("Content-Length", F.octet_length("html").cast("string"))).alias("headers"),
                         F.sha2(F.coalesce("html", F.lit("")), 256).alias("payload_digest"))
    revisits = p.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", F.timestamp_seconds(again).alias("ts"), F.lit(304).alias("status"),
                        headers(("ETAG", F.when(F.col("form") == 0, F.lit('"changed"')).when(F.col("form") == 1, F.concat(F.lit("W/"), "tag")).when(F.col("form") > 4, F.col("tag"))),
                                ("Last-Modified", F.when(F.col("form") != 2, F.col("day"))), ("Date", stamp(again)), ("Cache-Control", F.lit("max-age=600")), ("Content-Length", F.lit("0"))).alias("headers"),
                        F.lit(None).cast("string").alias("payload_digest"))
    return responses.unionByName(revisits)


def op7_revisits(spark, sf_dir: str) -> DataFrame:
    """All captures made of ``pages``, the not-modified ones resolved; headers as JSON, sorted by name."""
    out = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.withColumn("headers", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers")))))
