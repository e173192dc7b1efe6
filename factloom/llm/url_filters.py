"""URL filters by dated lists: an as-of join over validity intervals.

A list has dated entries (pattern, action, listed on).  Of one pattern each entry is valid
until the next one; an action ``none`` ends the listing.  Patterns are host names (with
all hosts below them) or a host and a path prefix of whole segments.  Every capture is
judged by the entries valid at its fetch time: the longest matching pattern decides.

Captures are reduced to distinct (host, path head, day) before the join, whose keys are
the suffixes of the host with the prefixes of the path: equality on the pattern and a range
on the day, no cross join.  Keys are made of all lengths (labels of the host, segments of
the path) that the list has, and of no others, as these meet no entry.
A list of at most ``BROADCAST_ROWS`` intervals is broadcast, after counting them; a longer
one is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 100_000
FOREVER = "9999-12-31"


def _bare(host) -> F.Column:
    """Lower-case host without user, port and a leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"^.*@", ""), r"(:[0-9]*)$|^www\.", "")


def normalised(pattern) -> F.Column:
    """A pattern as captures are compared: no scheme, host as ``host_of`` gives it, lower-case path without a slash at its end."""
    whole = F.regexp_replace(pattern, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, path = _bare(F.regexp_extract(whole, r"^([^/]*)", 1)), F.lower(F.regexp_replace(F.regexp_extract(whole, r"^[^/]*(/[\s\S]*)$", 1), r"/+$", ""))
    return F.when(host != "", F.concat(host, path))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (pattern, action, listed_on date) as pattern, action, valid_from, valid_to.

    valid_to is exclusive.  Patterns are normalised.  Entries without pattern, host, action
    or date are left out.  Of entries of one pattern and day the action last in the alphabet
    holds.
    """
    rows = entries.withColumn("pattern", normalised(F.col("pattern"))).filter("pattern is not null and action is not null and listed_on is not null")
    rows = rows.groupBy("pattern", "listed_on").agg(F.max("action").alias("action"))
    end = F.lead("listed_on").over(Window.partitionBy("pattern").orderBy("listed_on"))
    rows = rows.select("pattern", "action", F.col("listed_on").alias("valid_from"), F.coalesce(end, F.lit(FOREVER).cast("date")).alias("valid_to"))
    return rows.filter("action <> 'none'")


def host_of(url) -> F.Column:
    """Lower-case host without user, port and a leading www."""
    whole = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return _bare(whole)


def path_head(url, segments: int) -> F.Column:
    """The first ``segments`` segments of the path, lower case, empty if none."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.array_join(F.slice(F.split(F.lower(path), "/"), 1, segments), "/")


def patterns_of(host, head, shapes: list[tuple[int, int]]) -> F.Column:
    """All patterns of the given shapes (labels, segments) that match: the host and the domains above it, with the prefixes of the path head."""
    labels, segments = F.split(host, r"\."), F.when(head == "", F.array().cast("array<string>")).otherwise(F.split(head, "/"))
    kinds = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(k).alias("segments")) for n, k in shapes])
    fit = F.filter(kinds, lambda s: (s["labels"] <= F.size(labels)) & (s["segments"] <= F.size(segments)))
    domain = lambda s: F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), ".")
    return F.transform(fit, lambda s: F.array_join(F.concat(F.array(domain(s)), F.slice(segments, 1, s["segments"])), "/"))


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """One row per capture: page_id, host, fetched_on, verdict, pattern, listed_on.

    verdict is the action of the longest (normalised) pattern valid on the fetch day (of equally long
    ones the first in the alphabet), else ``none`` with null pattern and listed_on.  A url
    that is null or has no host, or a null time, matches nothing.  Repeated rows and null
    identifiers give their rows as they are.  An empty list matches nothing; an empty
    table gives an empty result.
    """
    valid = intervals(entries)
    sizes = (F.size(F.split(F.substring_index("pattern", "/", 1), r"\.")).alias("labels"), (F.size(F.split("pattern", "/")) - 1).alias("segments"))
    listed = valid.groupBy(*sizes).count().collect()  # one row for each pair of lengths
    shapes = sorted((r["labels"], r["segments"]) for r in listed) or [(1, 0)]
    rows = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_head(F.col(url_col), max(k for _, k in shapes)).alias("head"), F.to_date(time_col).alias("fetched_on"))
    kinds = rows.filter("host <> '' and fetched_on is not null").select("host", "head", "fetched_on").distinct()
    keys = kinds.withColumn("pattern", F.explode(patterns_of(F.col("host"), F.col("head"), shapes)))
    small = sum(r["count"] for r in listed) <= BROADCAST_ROWS
    met = keys.join(F.broadcast(valid) if small else valid, "pattern").filter("fetched_on >= valid_from and fetched_on < valid_to")
    best = met.groupBy("host", "head", "fetched_on").agg(F.min(F.struct((-F.length("pattern")).alias("size"), "pattern", "action", "valid_from")).alias("b"))
    # most captures of a hot host and day share one row of ``best``; Spark splits such a skewed join side
    out = rows.join(best, ["host", "head", "fetched_on"], "left")
    return out.select("page_id", "host", "fetched_on", F.coalesce("b.action", F.lit("none")).alias("verdict"), F.col("b.pattern").alias("pattern"), F.col("b.valid_from").alias("listed_on"))
