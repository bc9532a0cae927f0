"""Web archive revisits: "not modified" answers resolved to the response they stand for.

Records are captures of a URL at a time: full responses with validators (ETag, Last-Modified) and a payload,
and revisits with validators and headers of their own but none. A revisit resolves to the latest
earlier full response of the same canonical URL if its validators don't contradict that response's; the
headers that a "not modified" answer may renew are taken from it, the others from the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealens.llm.joins import join_counted
from arealens.scratch import stage

#: Headers that a 304 answer sends anew (RFC 9110, section 15.4.5) and those that describe it alone.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """One form for URLs that differ in scheme, ``www.``, host case, default port, fragment, tracking parameters, order of parameters or a trailing slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[a-z]+|fbclid|gclid)(=|$)")))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host == "", F.trim(url)).otherwise(whole)


def header_map(block: Column) -> Column:
    """map<string,string> of a header block: names in lower case, the last of a repeated one; lines without a colon are dropped."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]+:", "")).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def _validators_fit(own: Column, full: Column) -> Column:
    """An ETag decides if both have one (weak marks aside), else Last-Modified; a revisit without a common validator doesn't fit."""
    strong = lambda x: F.regexp_replace(x, "^W/", "")
    by_tag = strong(own["etag"]) == strong(full["etag"])
    return F.coalesce(by_tag, own["last-modified"] == full["last-modified"], F.lit(False))


def resolve_revisits(records: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """``records`` (record_id, kind ``response`` or ``revisit``, url, at timestamp, headers map) with
    canonical, refers_to, status and merged_headers.

    status: ``full`` for responses; ``resolved``; ``mismatch`` (validators contradict; refers_to names the
    response that was looked at, headers stay the revisit's own); ``orphan`` (none earlier, or url or time is null). At one
    time the response with the larger record_id is later, and a response at the revisit's own time counts as earlier. Other
    kinds get status null. Repeated rows are resolved each; an empty table gives none; other columns pass through.

    The as-of join runs in time buckets: the last response within each (URL, bucket), the last one of the
    buckets before it from one row a bucket, so a URL with a third of all captures is spread over its buckets.
    """
    records = records.drop("canonical", "refers_to", "status", "merged_headers").withColumn("canonical", canonical_url(F.col("url")))
    whole = (F.col("kind") == "response") & F.col("at").isNotNull() & F.col("canonical").isNotNull()
    mark = F.when(whole, F.struct("at", "record_id", "headers"))
    placed = records.withColumn("_b", F.floor(F.unix_timestamp("at") / bucket_seconds)).withColumn("_full", mark)
    upto = Window.partitionBy("canonical", "_b").orderBy("at", F.when(whole, 0).otherwise(1), "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = placed.withColumn("_near", F.last("_full", ignorenulls=True).over(upto))
    # One row for each URL and bucket, with the last response of the buckets before it.
    order = F.when(whole, F.struct("at", "record_id"))
    ends = placed.groupBy("canonical", "_b").agg(F.max_by("_full", order).alias("_last"))
    before = Window.partitionBy("canonical").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("canonical").alias("_u"), F.col("_b").alias("_c"), F.last("_last", ignorenulls=True).over(before).alias("_before")).where("_before is not null")
    found = seen.join(carried, (F.col("canonical") == F.col("_u")) & (F.col("_b") == F.col("_c")), "left").withColumn("_of", F.coalesce("_near", "_before"))
    revisit = F.col("kind") == "revisit"
    usable = revisit & F.col("_of").isNotNull() & F.col("at").isNotNull() & F.col("canonical").isNotNull()
    fits = usable & _validators_fit(F.col("headers"), F.col("_of.headers"))
    renewed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("_of.headers", lambda k, v: ~F.map_contains_key(renewed, k))
    return found.select(
        *records.columns,
        F.when(usable, F.col("_of.record_id")).alias("refers_to"),
        F.when(F.col("kind") == "response", "full").when(fits, "resolved").when(usable, "mismatch").when(revisit, "orphan").alias("status"),
        F.when(fits, F.map_concat(kept, renewed)).otherwise(F.col("headers")).alias("merged_headers"),
    )


def attach_payloads(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """``resolved`` with payload: the record's own, or for a resolved revisit that of the response it refers to; ``payloads`` has record_id and payload, one row each."""
    source = F.when(F.col("status") == "resolved", F.col("refers_to")).when(F.col("status") == "full", F.col("record_id"))
    stored = payloads.select(F.col("record_id").alias("_r"), "payload")
    return resolved.drop("payload").withColumn("_s", source).join(stored, F.col("_s") == F.col("_r"), "left").drop("_s", "_r")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of crawled pages: each page is a response, and two later visits to it are "not modified" answers.

    Page p is fetched at p minutes from an epoch, asked for again 90 minutes and (by another spelling of its URL) a day
    later. Every fifth page's second visit has the ETag of another version; every seventh page's sends no ETag but a date.
    """
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.crc32(F.coalesce("html", F.lit("")).cast("binary")).cast("string"), F.lit('"'))
    stamp = F.date_format(start, "yyyy-MM-dd HH:mm:ss")
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    length = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    first = F.concat(line("ETag", tag), line("Last-Modified", stamp), line("Content-Type", F.lit("text/html")), line("Content-Length", length), line("Cache-Control", F.lit("max-age=60")))
    again = F.concat(line("ETag", F.concat(F.lit("W/"), tag)), line("Cache-Control", F.lit("max-age=600")), line("Content-Length", F.lit("0")))
    other = F.when(F.col("page_id") % 5 == 0, line("ETag", F.lit('"other"'))).when(F.col("page_id") % 7 == 0, line("Last-Modified", stamp)).otherwise(line("ETag", tag))
    visits = F.array(
        F.struct((F.col("page_id") * 3).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("url"), start.alias("at"), first.alias("block")),
        F.struct((F.col("page_id") * 3 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.col("url").alias("url"), (start + F.expr("INTERVAL 90 MINUTES")).alias("at"), again.alias("block")),
        F.struct((F.col("page_id") * 3 + 2).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(F.col("url"), F.lit("#again")).alias("url"), (start + F.expr("INTERVAL 1 DAY")).alias("at"), F.concat(other, line("Server", F.lit("edge"))).alias("block")),
    )
    return pages.select(F.explode(visits).alias("r")).select("r.record_id", "r.kind", "r.url", "r.at", header_map(F.col("r.block")).alias("headers"))
