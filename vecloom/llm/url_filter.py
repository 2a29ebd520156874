"""URL filter by a temporal list join.

A list is a log of dated entries: from ``listed_at`` on, a key (a host or a domain, with or
without a path prefix) is blocked, allowed or cleared. Entries of one list and key become
validity intervals, each until the next entry. A capture is looked up under all keys that
cover its URL, as of its fetch time; the most specific active entry decides.

Expressions and joins only. A key's intervals are cut at calendar months, so that a capture
meets the one or two intervals of its month however often a key changed; captures of one
host are spread over ``SALTS`` by a hash of their id, and the (few) list rows are copied to
each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

SALTS = 8

_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dots; null without a scheme and host."""
    authority = F.regexp_extract(url, _URL, 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:[0-9]*)?$", ""))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def keys_of(host: Column, path: Column, depth: int) -> Column:
    """All keys that can cover a URL: the host and its parent domains, alone and with path prefixes of up to ``depth`` segments."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(segments), F.lit(depth))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, n), "/"))),
    )
    return F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, valid_from, valid_to): an entry holds until the next of its list and key.

    Of several entries of one list, key and time the strictest holds: block, then allow, then
    clear. Cleared stretches are no intervals. ``valid_to`` is null while an entry still holds.
    """
    strictness = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    dated = (
        entries.select(
            F.col("list"), F.lower("key").alias("key"), F.lower("action").alias("action"), F.col("listed_at").cast("timestamp")
        )
        .filter("list is not null and key is not null and listed_at is not null")
        .groupBy("list", "key", "listed_at")
        .agg(F.max(strictness).alias("strictness"))
    )
    later = Window.partitionBy("list", "key").orderBy("listed_at")
    return (
        dated.withColumn("valid_to", F.lead("listed_at").over(later))
        .filter("strictness > 0")
        .select(
            "list",
            "key",
            F.when(F.col("strictness") == 2, "block").otherwise("allow").alias("action"),
            F.col("listed_at").alias("valid_from"),
            "valid_to",
        )
    )


def _month(time: Column) -> Column:
    return F.year(time) * 12 + F.month(time)


def filter_urls(
    captures: DataFrame,
    entries: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    time_col: str = "fetched_at",
    salts: int = SALTS,
) -> DataFrame:
    """Per capture: id, url, fetched_at, host, kept, list, key, action and valid_from of the deciding entry.

    The longest key decides; of equal keys the block before the allow, then the first list by
    name. A capture without an active entry is kept and its entry columns are null. A null or
    relative URL has no host and a null fetch time no active entries: both are kept. Keys with
    upper-case letters match lower-case hosts (paths are compared lower-case as well). A key's path
    can have any number of segments; URLs are cut to the greatest number in the list. Repeated
    captures are judged each. Columns of either table beyond those named are not read. Empty
    lists keep everything; no captures give an empty result.
    """
    seen = captures.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{time_col}`").cast("timestamp").alias("fetched_at"),
    ).withColumn("host", host_of(F.col("url")))
    # Slashes of a key are the segments of its path; only so many prefixes of a URL can match.
    slashes = F.length("key") - F.length(F.replace(F.col("key"), F.lit("/")))
    depth = entries.filter("list is not null and key is not null and listed_at is not null").agg(F.max(slashes)).first()[0] or 0
    keyed = (
        seen.filter("host is not null and fetched_at is not null")
        .select("id", "url", "fetched_at", "host", F.lower(F.regexp_extract("url", _URL, 2)).alias("path"))
        .distinct()
        .select("id", "url", "fetched_at", F.explode(keys_of(F.col("host"), F.col("path"), depth)).alias("key"))
        .withColumn("month", _month(F.col("fetched_at")))
        .withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)))
    )
    span = seen.agg(F.max(_month(F.col("fetched_at"))).alias("last"), F.min(_month(F.col("fetched_at"))).alias("first"))
    last, first = span.first()
    intervals = validity_intervals(entries)
    begin = F.greatest(_month(F.col("valid_from")), F.lit(first).cast("int"))
    end = F.least(F.coalesce(_month(F.col("valid_to")), F.lit(last).cast("int")), F.lit(last).cast("int"))
    monthly = (
        intervals.filter(begin <= end)
        .withColumn("month", F.explode(F.sequence(begin, end)))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    )
    active = keyed.join(monthly, ["key", "month", "salt"]).filter(
        (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    )
    order = F.struct(
        (-F.length("key")).alias("length"),
        F.when(F.col("action") == "block", 0).otherwise(1).alias("strict"),
        "list",
        "key",
        "action",
        "valid_from",
    )
    decided = active.groupBy("id", "url", "fetched_at").agg(F.min(order).alias("entry"))
    decided = decided.select(F.col("id").alias("of_id"), F.col("url").alias("of_url"), F.col("fetched_at").alias("of_time"), "entry")
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("url") == F.col("of_url")) & (F.col("fetched_at") == F.col("of_time"))
    return seen.join(decided, same, "left").select(
        F.col("id").alias(id_col),
        "url",
        "fetched_at",
        "host",
        (F.coalesce(F.col("entry.action"), F.lit("allow")) != "block").alias("kept"),
        F.col("entry.list").alias("list"),
        F.col("entry.key").alias("key"),
        F.col("entry.action").alias("action"),
        F.col("entry.valid_from").alias("valid_from"),
    )
