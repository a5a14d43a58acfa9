"""URL filters by a temporal list join.

Dated entries (domain, listed_on, status) become validity intervals: an entry holds from its day to the day before the domain's
next one. Every capture is evaluated against the entries that were active when it was fetched, for its host and each
parent domain of two labels or more; the longest listed domain decides. The as-of join is done once for each distinct
(host, day), so a host that a third of all captures share is looked up once a day; only built-in functions are used.

Defined results: a null URL or one without a host, and a capture without a time, match no entry and are kept with null
matches; entries without a domain or date are ignored; of entries of one domain and day `block` wins; repeated captures
each get a row; with an empty list everything is kept; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/:?#\[\]]+)"
ADDRESS = r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL without a final dot, or null; an IPv6 address keeps its brackets."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains, two labels at least (a host of one label is its own); an address has no parents."""
    parts = F.split(host, r"\.")
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(_parents(parts))


def _parents(parts: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """(domain, status, valid_from, valid_to): valid_to is the day of the domain's next entry, or null."""
    days = entries.where("domain IS NOT NULL AND listed_on IS NOT NULL").groupBy(F.regexp_replace(F.lower("domain"), r"\.$", "").alias("domain"), F.col("listed_on").alias("valid_from"))
    days = days.agg(F.max(F.col("status") == "block").alias("blocks"))
    following = F.lead("valid_from").over(Window.partitionBy("domain").orderBy("valid_from"))
    return days.select("domain", F.when(F.col("blocks"), "block").otherwise("allow").alias("status"), "valid_from", following.alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """id, host, fetched_on, matched_domain, status, listed_on, kept for each capture."""
    own = captures.select(captures[id_col].alias("id"), host_of(captures[url_col]).alias("host"), captures[time_col].cast("date").alias("fetched_on"))
    asked = own.select("host", "fetched_on").where("host IS NOT NULL AND fetched_on IS NOT NULL").distinct()
    looked_up = asked.select("host", "fetched_on", F.explode(domains_of(F.col("host"))).alias("domain"))
    lists = validity(entries)
    active = (lists["valid_from"] <= looked_up["fetched_on"]) & (lists["valid_to"].isNull() | (looked_up["fetched_on"] < lists["valid_to"]))
    matched = looked_up.join(lists, (looked_up["domain"] == lists["domain"]) & active).select("host", "fetched_on", F.struct(F.length(lists["domain"]).alias("size"), lists["domain"], lists["status"], lists["valid_from"]).alias("m"))
    decided = matched.groupBy("host", "fetched_on").agg(F.max("m").alias("m"))
    joined = own.join(decided, ["host", "fetched_on"], "left")
    kept = F.coalesce(F.col("m.status") != "block", F.lit(True))
    return joined.select(F.col("id").alias(id_col), "host", "fetched_on", F.col("m.domain").alias("matched_domain"), F.col("m.status").alias("status"), F.col("m.valid_from").alias("listed_on"), kept.alias("kept"))
