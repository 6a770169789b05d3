"""URL filters as a temporal list join (operator 6), with DataFrame functions.

List entries are dated: an entry is added to or removed from a list on a day. Entries become validity
intervals (from an addition to the next change), and every capture is held as of its fetch time
against the entries active then: of its host, of the domains above it, and of the path prefixes
of its URL. Of an entry at most one interval is active at a time.

Intervals are dealt over periods of PERIOD_DAYS that they overlap, and a capture looks up its own
period, so the join's keys are (entry, period): a host with a third of all captures is
spread over time, and many changes of one entry don't meet all captures of it. Both sides of the
join are plain exchanges, so Spark splits a key that still has too many captures within a period.

Defined results: null or odd URLs have no host and match nothing; a null fetch time matches nothing;
hosts of entries and URLs are compared without case, paths with it;
of changes on one date removal is the last; repeated captures are judged each; repeated entries count
once; without entries nothing is blocked; other columns, also of clashing names, are ignored; of a URL
of any length only the prefixes that an entry can have are looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.session import materialize

PERIOD_DAYS = 16
#: Host of a URL: after the scheme and any user, without port; and the path without its last slash.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1), r"\.+$", "")


def depth_of(entries: DataFrame) -> int:
    """Path segments of the deepest prefix entry."""
    deepest = F.max(F.length("key") - F.length(F.translate("key", "/", "")))
    return entries.where("kind = 'prefix'").agg(F.coalesce(deepest, F.lit(0)).alias("n")).first().n


def keys_of(url: Column, deepest: int) -> Column:
    """(kind, key) of all entries that can concern a URL. No entry is a longer prefix than of ``deepest``
    segments, so longer ones aren't made: their lengths would add up to the square of a path's."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    depth = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, depth), ".").alias("key")))
    path = F.rtrim(F.regexp_extract(F.coalesce(url, F.lit("")), "(?i)" + PATH, 1), F.lit("/"))
    parts = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, deepest) if deepest else F.array().cast("array<string>")
    prefixes = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("key"))),
    ).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")))
    return F.when(host != "", F.concat(own, domains, prefixes)).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, since, until) of entries (list, kind, key, action, at): when each was active."""
    changes = entries.select("list", "kind", F.lower("key").alias("_low"), "key", "action", "at").where("at IS NOT NULL AND key IS NOT NULL")
    # hosts have no case, paths do; a last slash says nothing
    host = F.substring_index("key", "/", 1)
    prefix = F.rtrim(F.concat(F.lower(host), F.substr("key", F.length(host) + 1)), F.lit("/"))
    key = F.when(F.col("kind") == "prefix", prefix).otherwise(F.col("_low"))
    last = changes.groupBy("list", "kind", key.alias("key"), "at").agg(F.max("action").alias("action"))  # add < remove
    following = F.lead("at").over(Window.partitionBy("list", "kind", "key").orderBy("at"))
    return last.withColumn("until", following).where("action = 'add'").select("list", "kind", "key", F.col("at").alias("since"), "until")


def _period(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / (PERIOD_DAYS * 86400)).cast("long")


def evaluate(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Of each capture: id, blocked, n_lists, the least name of the lists that block it, and the day from
    which the oldest of the active entries holds."""
    rows = captures.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("at"))
    rows = materialize(rows, "captures")
    span = rows.agg(F.min(_period(F.col("at"))).alias("lo"), F.max(_period(F.col("at"))).alias("hi")).first()
    lo, hi = (span.lo, span.hi) if span.lo is not None else (0, -1)
    first, last = F.greatest(_period(F.col("since")), F.lit(lo)), F.least(F.coalesce(_period(F.col("until")), F.lit(hi)), F.lit(hi))
    active = intervals(entries).where(first <= last).withColumn("period", F.explode(F.sequence(first, last)))
    asked = rows.where("at IS NOT NULL").select("row", "at", _period(F.col("at")).alias("period"), F.explode(keys_of(F.col("url"), depth_of(entries))).alias("k"))
    asked = asked.select("row", "at", "period", "k.kind", "k.key")
    hits = asked.join(active, ["kind", "key", "period"]).where((F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    verdicts = hits.groupBy("row").agg(F.count_distinct("list").alias("n_lists"), F.min("list").alias("list"), F.min("since").alias("since"))
    joined = rows.select("row", "id").join(verdicts, "row", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n_lists").isNotNull().alias("blocked"), F.coalesce("n_lists", F.lit(0)).cast("long").alias("n_lists"), "list", "since")
