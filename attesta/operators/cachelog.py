"""A verified cache as an append-only event log: everything else is derived from it.

Events are (id, url, kind, at, status, sha256, size, error, http_status, retry_after); ``at`` is in epoch seconds.  Time never
comes from a clock here, callers give ``now``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.numbers import back_off, clamp

# ---- fixed values --------------------------------------------------------------------------------------------------
STORED = ("downloaded", "adopted")
CHECKED = ("downloaded", "unchanged", "not-modified")
TTL_SECONDS = {"json": 7 * 86400.0, "image": 30 * 86400.0}
RETRY_DELAY, PACE = 300.0, 0.5
# --------------------------------------------------------------------------------------------------------------------


def ttl(kind: Column) -> Column:
    out = F.lit(TTL_SECONDS["json"])
    for k, v in TTL_SECONDS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def entries(events: DataFrame, delay: float = RETRY_DELAY) -> DataFrame:
    """The current row of each url: a failure keeps the body, its streak sets the next try.  One grouped pass.

    The streak is counted from the last good event: its id is known within the same pass, as ids ascend with time."""
    good = F.col("status").isin(*CHECKED, *STORED)
    body = F.col("status").isin(*CHECKED, *STORED) & F.col("sha256").isNotNull()
    last_good = F.max(F.when(good, F.col("id"))).over(Window.partitionBy("url"))
    marked = events.withColumn("_failed", (F.col("status") == "failed") & (F.col("id") > F.coalesce(last_good, F.lit(-1))))
    found = marked.groupBy("url").agg(
        F.min("at").alias("first_seen"),
        F.max_by(F.when(body, F.col("sha256")), F.when(body, F.col("id"))).alias("sha256"),
        F.max(F.when(F.col("status") == "downloaded", F.col("at"))).alias("fetched_at"),
        F.max(F.when(F.col("status").isin(*CHECKED), F.col("at"))).alias("checked_at"),
        F.max(F.when(good, F.col("at"))).alias("valid_at"),
        F.count_if("_failed").alias("failures"),
        F.max(F.when(F.col("_failed"), F.col("at"))).alias("failed_at"),
        F.max_by("status", "id").alias("last_status"),
    )
    return found.withColumn("retry_at", F.when(F.col("failures") > 0, F.col("failed_at") + back_off(F.lit(delay), F.col("failures"))))


def versions(events: DataFrame) -> DataFrame:
    """(url, sha256, first_seen, last_seen, times) of every body that a url ever had."""
    seen = events.where(F.col("status").isin(*CHECKED, *STORED) & F.col("sha256").isNotNull())
    return seen.groupBy("url", "sha256").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("times"))


def blobs(events: DataFrame) -> DataFrame:
    """(sha256, prefix, urls): bodies by content, each once, with the folder that holds them."""
    return events.where("sha256 is not null").groupBy("sha256").agg(F.count_distinct("url").alias("urls")).withColumn("prefix", F.substring("sha256", 1, 2))


def history(events: DataFrame, url: str | None = None, limit: int = 100) -> DataFrame:
    """The latest events, of one url if given; between 1 and 10,000 of them."""
    some = events if url is None else events.where(F.col("url") == url)
    return some.orderBy(F.desc("id")).limit(max(1, min(limit, 10_000)))


def listed(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc(F.coalesce("checked_at", "first_seen")), "url")


def totals(events: DataFrame) -> DataFrame:
    """One row: events, urls, distinct bodies, failures and the last id."""
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("url").alias("urls"), F.count_distinct("sha256").alias("bodies"), F.count_if(F.col("status") == "failed").alias("failures"), F.max("id").alias("last_id"))


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def is_fresh(mode: Column | str, now: Column, expires_at: Column, checked_at: Column, call_start: Column) -> Column:
    """Whether a valid body may be used without asking: always if offline or manual, else until it expires, or if this call has
    checked it already."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return mode.isin("manual", "offline") | F.coalesce((mode == "auto") & (now < expires_at), F.lit(False)) | F.coalesce(checked_at >= call_start, F.lit(False))


def decision(mode: Column, valid: Column, fresh: Column, retry_at: Column, blocked_until: Column, now: Column, has_entry: Column, has_seed: Column) -> Column:
    """What a request does next, in the order of the rules: adopt, hit, offline-hit, error, stale-backoff, conditional or plain get."""
    wait = F.greatest(F.coalesce(retry_at, F.lit(0.0)), F.coalesce(blocked_until, F.lit(0.0)))
    return (
        F.when(~has_entry & has_seed, "adopt")
        .when(valid & fresh, F.when(mode == "offline", "offline-hit").otherwise("hit"))
        .when(mode == "offline", "error")
        .when(wait > now, F.when(valid, "stale-backoff").otherwise("error"))
        .when(valid, "conditional-get")
        .otherwise("get")
    )


def due(rows: DataFrame, now: float) -> DataFrame:
    """Entries that an update has to look at."""
    kind = F.col("kind") if "kind" in rows.columns else F.lit("json")
    expires = F.coalesce(F.col("valid_at"), F.lit(0.0)) + ttl(kind)
    return rows.where((expires <= now) & (F.coalesce(F.col("retry_at"), F.lit(0.0)) <= now))


def host_blocks(events: DataFrame) -> DataFrame:
    """(host, blocked_until): only answers that speak for a whole host block it."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    asked = events.where(F.col("http_status").isin(429, 503))
    return asked.groupBy(host.alias("host")).agg(F.max(F.col("at") + F.greatest(F.lit(RETRY_DELAY), F.coalesce("retry_after", F.lit(0.0)))).alias("blocked_until"))


def too_fast(events: DataFrame, pace: float = PACE) -> DataFrame:
    """Requests of a host that came sooner than ``pace`` after the one before."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("host").orderBy("at", "id"))
    return events.withColumn("host", host).withColumn("gap", gap).where(F.col("gap") < pace)


def reusable(wanted: DataFrame, done: DataFrame, stamp: str = "stamp") -> tuple[DataFrame, DataFrame]:
    """(results to reuse, work that is left) by content stamp."""
    return wanted.join(done, stamp), wanted.join(done.select(stamp).distinct(), stamp, "left_anti")


def history_limit(limit: Column) -> Column:
    return clamp(limit, 1, 10_000)
