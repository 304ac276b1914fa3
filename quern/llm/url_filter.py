"""Temporal list join: dated list entries become validity intervals; an as-of join judges every capture at its fetch time.

An entry is (pattern, day, action): from `day` on, `pattern` has `action` (block, allow, or none to lift it), until the
pattern's next entry. Patterns are hosts (which cover their subdomains) or hosts with a path prefix ending in "/".
The longest active pattern decides; without one the capture is kept.

Of entries with one pattern and day the smallest action counts. Null urls, urls without a host and null days match
nothing. Entries with a null pattern or day are ignored. Repeated captures are each judged. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def path_of(url: F.Column) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, from_day, to_day, action): to_day is exclusive, null while the entry is the last."""
    one = entries.filter("pattern is not null and day is not null").groupBy("pattern", "day").agg(F.min("action").alias("action"))
    after = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return one.select("pattern", F.col("day").alias("from_day"), after.alias("to_day"), "action").filter("action <> 'none'")


def candidates(url: F.Column) -> F.Column:
    """All patterns that could cover a url: its host, parent domains of two labels or more, and its path prefixes."""
    host, path = host_of(url), path_of(url)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.when(F.size(labels) <= 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    # parts starts with "" for the leading slash, and its last item is the file name
    prefixes = F.when(F.size(parts) >= 2, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, day) of captures, with blocked, action and pattern of the entry that decides.

    Captures are pre-aggregated: each different (host and path prefixes, day) is judged once, so a host with a
    third of all captures meets the list only once a day and path; the decision then joins back.
    """
    rows = captures.select("page_id", "url", "day", F.concat(host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), r"^(.*/)", 1)).alias("_place"), F.concat(F.lit("u://"), host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), r"^(.*/)", 1)).alias("_u"))
    places = rows.filter("day is not null").select("_place", "_u", "day").distinct()
    wide = places.select("_place", "day", F.explode(candidates(F.col("_u"))).alias("pattern"))
    live = intervals(entries)
    hits = wide.join(live, "pattern").filter((F.col("day") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day"))))
    best = hits.groupBy("_place", "day").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action")).alias("best"))
    best = best.select("_place", "day", "best.action", "best.pattern")
    out = rows.join(best, ["_place", "day"], "left")
    return out.select("page_id", "url", "day", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"), "action", "pattern")
