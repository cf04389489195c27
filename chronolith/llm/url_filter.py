"""URL filters by a temporal list join.

Dated list entries (list, key, action, dated_at) become validity intervals: an ``add`` holds until
the next entry for the same list and key. Every capture is joined as of its fetch time with the
intervals of its keys: its host, the parent domains of two or more labels, and the host with each
leading part of the path, as deep as the deepest key of the lists. Hosts are compared in lower case and
without the dot that may end them, paths as they are written. Addresses (IPv4, and IPv6 in brackets)
have no parent domains.

Intervals are laid over months and the join is on key and month, so a hot host is spread over time
and a capture meets only entries of its month. The list side is broadcast only up to a counted size.

Defined cases: of entries of one list, key and time, a ``remove`` wins; entries with a null are
ignored; captures with a null url or fetch time match nothing; a url without scheme and host has no
keys; rows equal in id, url and fetch time are one capture; empty tables give no matches or no rows;
other columns, of any name, are not read; the name of the id may be any but those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"
ADDRESS = r"^\[|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def _month(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t)


def keys(url: Column, depth: int) -> Column:
    """Domains of two or more labels (or the only label), and the host with the first 1..depth path parts."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = F.when(host(url).rlike(ADDRESS), F.array(host(url))).otherwise(domains)
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != "")
    deep = F.least(F.size(parts), F.lit(depth))
    paths = F.when(deep > 0, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.when(host(url) != "", F.concat(domains, F.coalesce(paths, F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))


def list_key(key: Column) -> Column:
    """A list's key as ``keys`` writes it: the host in lower case, the path as it is."""
    return F.concat(F.regexp_replace(F.lower(F.substring_index(key, "/", 1)), r"\.$", ""), F.regexp_replace(key, "^[^/]*", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, valid_from, valid_to (exclusive, null where open) of the entries that are active."""
    known = entries.select("list", list_key(F.col("key")).alias("key"), "action", F.col("dated_at").cast("timestamp").alias("dated_at")).dropna()
    one = known.groupBy("list", "key", "dated_at").agg(F.max("action").alias("action"))
    nxt = F.lead("dated_at").over(Window.partitionBy("list", "key").orderBy("dated_at"))
    return one.withColumn("valid_to", nxt).where("action = 'add'").select("list", "key", F.col("dated_at").alias("valid_from"), "valid_to")


@C.scoped
def evaluate(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id") -> DataFrame:
    """capture id, url, fetched_at, host and matches: the sorted (list, key) that were active, for each capture."""
    ranges = C.materialize(intervals(entries), "list-intervals")
    depth = ranges.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    last = captures.agg(F.max("fetched_at").cast("timestamp")).first()[0]
    shown = captures.select(F.col(capture_id), "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    to = F.least(F.coalesce("valid_to", F.lit(last)), F.lit(last))
    months = F.explode(F.when(F.col("valid_from") <= to, F.sequence(_month(F.col("valid_from")), _month(to))))
    ranges = C.join_side(C.materialize(ranges.select("list", F.col("key").alias("list_key"), "valid_from", "valid_to", months.alias("in_month")), "list-months"))
    asked = shown.select("*", host(F.col("url")).alias("host"), F.explode(F.concat(F.array(F.lit("")), F.coalesce(keys(F.col("url"), depth), F.array().cast("array<string>")))).alias("key"))
    # the empty key keeps every capture; it is dealt out by id, as no list has it
    at = F.when(F.col("key") == "", -1 - F.pmod(F.xxhash64(capture_id), F.lit(1 << 20))).otherwise(_month(F.col("fetched_at")))
    met = asked.withColumn("month", at).join(ranges, (F.col("key") == F.col("list_key")) & (F.col("month") == F.col("in_month")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))), "left")
    met = met.where("key = '' OR list IS NOT NULL")
    match = F.when(F.col("list").isNotNull(), F.struct("list", F.col("list_key").alias("key")))
    return met.groupBy(capture_id, "url", "fetched_at", "host").agg(F.array_sort(F.collect_set(match)).alias("matches"))
