"""Keyed snapshots in long form: differences, merges under a policy, corrections and the overlay for export.

A snapshot is two tables, ``ENTITIES`` and ``READINGS`` of ``attesta.domain``.  Three rules hold everywhere: an unknown value
stays null, absence is not deletion, and inputs are not changed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.domain import UNLOCKED, VALUELESS, WIRE_KEYS, bounds, is_accepted, wire_keys


class Snapshot(NamedTuple):
    entities: DataFrame
    readings: DataFrame


class Difference(NamedTuple):
    ids: DataFrame  # (entity_id, side): added or missing
    changes: DataFrame  # (entity_id, field, before_value, before_status, after_value, after_status)
    identity_changes: DataFrame  # (entity_id, before, after)
    unresolved: DataFrame  # (side, key)


def _known(df: DataFrame) -> DataFrame:
    return df.where("entity_id is not null")


def id_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids on one side only.  Missing means not in this snapshot, nothing more."""
    a, b = _known(before).select("entity_id").distinct(), _known(after).select("entity_id").distinct()
    both = a.withColumn("old", F.lit(True)).join(b.withColumn("new", F.lit(True)), "entity_id", "full")
    return both.where("old is null or new is null").select("entity_id", F.when(F.col("old").isNull(), "added").otherwise("missing").alias("side"))


def field_changes(before: Snapshot, after: Snapshot) -> DataFrame:
    """Readings that differ, of entities on both sides; a reading that is absent counts as (null, unknown)."""
    common = _known(before.entities).select("entity_id").join(_known(after.entities).select("entity_id"), "entity_id", "left_semi").distinct()
    side = lambda s, n: _known(s.readings).join(common, "entity_id", "left_semi").select("entity_id", "field", F.col("value").alias(f"{n}_value"), F.col("status").alias(f"{n}_status"))
    joined = side(before, "before").join(side(after, "after"), ["entity_id", "field"], "full")
    joined = joined.withColumns({f"{n}_status": F.coalesce(f"{n}_status", F.lit("unknown")) for n in ("before", "after")})
    same = F.col("before_value").eqNullSafe(F.col("after_value")) & (F.col("before_status") == F.col("after_status"))
    return joined.where(~same)


def difference(before: Snapshot, after: Snapshot) -> Difference:
    a, b = _known(before.entities), _known(after.entities)
    identity = a.select("entity_id", F.col("identity_status").alias("before")).join(b.select("entity_id", F.col("identity_status").alias("after")), "entity_id").where("before <> after")
    loose = lambda s, n: s.entities.where("entity_id is null").select(F.lit(n).alias("side"), "key")
    return Difference(id_difference(before.entities, after.entities), field_changes(before, after), identity, loose(before, "before").union(loose(after, "after")))


def in_order(found: Difference) -> Difference:
    """The same rows in the order in which they are shown: ids, then fields."""
    return Difference(found.ids.orderBy("side", "entity_id"), found.changes.orderBy("entity_id", "field"), found.identity_changes.orderBy("entity_id"), found.unresolved.orderBy("side", "key"))


class Merge(NamedTuple):
    snapshot: Snapshot
    applied: DataFrame  # (entity_id, field, before, after)
    held: DataFrame  # (key, entity_id, field, reason)


def _keeps_identity(old: Column, new: Column) -> Column:
    """What was confirmed isn't weakened by an observation."""
    return old.isin("confirmed", "corrected") & new.isin("observed", "inferred")


def _filled(base: Column, more: Column) -> Column:
    """Entries of ``base``, and those of ``more`` under other keys."""
    base, more = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (base, more))
    return F.map_concat(F.map_filter(more, lambda k, _: ~F.map_contains_key(base, k)), base)


def _appended(old: Column, new: Column) -> Column:
    return F.concat(*(F.coalesce(x, F.array().cast("array<struct<kind:string,uri:string,details:string>>")) for x in (old, new)))


def merge(base: Snapshot, incoming: Snapshot, *, allow_observed: bool = False) -> Merge:
    """Accepted incoming readings update ``base`` or insert into it; nothing is deleted and unknown never becomes a value."""
    ok = F.col("entity_id").isNotNull() & is_accepted("identity_status", allow_observed)
    taken = incoming.entities.where(ok)
    refused = incoming.entities.where(~ok).select("key", F.lit(None).cast("long").alias("entity_id"), F.lit(None).cast("string").alias("field"), F.lit("identity not accepted").alias("reason"))

    readings = incoming.readings.join(taken.select("entity_id").distinct(), "entity_id", "left_semi")
    usable = F.col("value").isNotNull() & is_accepted("status", allow_observed)
    held = refused.unionByName(readings.where(~usable).select(F.lit(None).cast("string").alias("key"), "entity_id", "field", F.col("status").alias("reason")))
    new = readings.where(usable).select("entity_id", "field", *(F.col(c).alias(f"new_{c}") for c in ("value", "status", "sources")))

    loose = base.readings.where("entity_id is null")
    old = _known(base.readings).select("entity_id", "field", F.col("key").alias("old_key"), *(F.col(c).alias(f"old_{c}") for c in ("value", "status", "sources")))
    both = old.join(new, ["entity_id", "field"], "full")
    comes, same = F.col("new_status").isNotNull(), F.col("old_value") == F.col("new_value")
    status = F.when(~comes, F.col("old_status")).when(same & _keeps_identity(F.col("old_status"), F.col("new_status")), F.col("old_status")).otherwise(F.col("new_status"))
    sources = F.when(~comes, F.col("old_sources")).when(same, _appended(F.col("old_sources"), F.col("new_sources"))).otherwise(F.col("new_sources"))
    merged = both.select(F.coalesce("old_key", F.concat(F.lit("entity_"), F.col("entity_id"))).alias("key"), "entity_id", "field", F.when(comes, F.col("new_value")).otherwise(F.col("old_value")).alias("value"), status.alias("status"), sources.alias("sources"))
    applied = new.join(old, ["entity_id", "field"], "left").select("entity_id", "field", F.col("old_value").alias("before"), F.col("new_value").alias("after"))

    mine = _known(base.entities).select("entity_id", *(F.col(c).alias(f"old_{c}") for c in ("key", "name", "identity_status", "extensions", "sources")))
    theirs = taken.select("entity_id", *(F.col(c).alias(f"new_{c}") for c in ("name", "identity_status", "extensions", "sources")))
    pair = mine.join(theirs, "entity_id", "full")
    seen = F.col("new_identity_status").isNotNull()
    identity = F.when(~seen | _keeps_identity(F.col("old_identity_status"), F.col("new_identity_status")), F.coalesce("old_identity_status", "new_identity_status")).otherwise(F.col("new_identity_status"))
    entities = pair.select(
        F.coalesce("old_key", F.concat(F.lit("entity_"), F.col("entity_id"))).alias("key"),
        "entity_id",
        F.coalesce(F.nullif("new_name", F.lit("")), "old_name", "new_name").alias("name"),
        identity.alias("identity_status"),
        _filled(F.col("old_extensions"), F.col("new_extensions")).alias("extensions"),
        _appended(F.col("old_sources"), F.col("new_sources")).alias("sources"),
    )
    columns = ["key", "entity_id", "field", "value", "status", "sources"]
    result = Snapshot(entities.unionByName(base.entities.where("entity_id is null").select(entities.columns)), merged.select(columns).unionByName(loose.select(columns)))
    return Merge(result, applied, held)


def corrected(readings: DataFrame, patch: DataFrame) -> DataFrame:
    """``readings`` with the values of ``patch`` (key, field, value); null takes a value back to unknown.  A key or field that
    the snapshot or its bounds don't know, or a value out of bounds, stops the query."""
    spark = readings.sparkSession
    keys = readings.select("key").distinct().withColumn("known", F.lit(True))
    allowed = F.broadcast(bounds(spark))  # 19 rows
    checked = patch.join(keys, "key", "left").join(allowed, "field", "left")
    problem = F.when(F.col("known").isNull(), F.concat(F.lit("unknown key: "), F.col("key"))).when(F.col("low").isNull() | ~F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(True)), F.concat(F.lit("invalid correction: "), F.col("field")))
    checked = checked.select("key", "field", F.when(problem.isNotNull(), F.raise_error(problem).cast("long")).otherwise(F.col("value")).alias("new_value"), F.lit(True).alias("patched"))
    joined = readings.join(checked, ["key", "field"], "full")
    value = F.when(F.col("patched"), F.col("new_value")).otherwise(F.col("value"))
    status = F.when(F.col("patched"), F.when(F.col("new_value").isNull(), "unknown").otherwise("corrected")).otherwise(F.col("status"))
    return joined.select("key", "field", value.alias("value"), status.alias("status"))


def duplicates(entities: DataFrame, *by: str) -> DataFrame:
    """Keys that stand more than once, with their count."""
    return entities.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def overlay(readings: DataFrame, baseline: DataFrame, extras: DataFrame, *, allow_observed: bool = False) -> DataFrame:
    """(entity_id, wire_key, value): what an export writes for each entity.

    Accepted readings overwrite the baseline's entries, extras fill only keys that nothing else has and that no field maps to."""
    spark = readings.sparkSession
    keys = F.broadcast(wire_keys(spark))  # 16 rows
    use = readings.where(F.col("value").isNotNull() & is_accepted("status", allow_observed)).join(keys, "field").join(F.broadcast(bounds(spark)), "field")
    value = F.when(F.col("field").isin(*UNLOCKED) & (F.col("value") == 0), F.lit(1)).otherwise(F.col("value"))
    good = F.when(F.col("value").between(F.col("low"), F.col("high")), value).otherwise(F.raise_error(F.concat(F.lit("out of range: "), F.col("field"))).cast("long"))
    mine = use.select("entity_id", "wire_key", good.alias("reading"))
    fill = extras.where(~F.col("wire_key").isin(*WIRE_KEYS.values())).select("entity_id", "wire_key", F.col("value").alias("extra"))
    base = baseline.select("entity_id", "wire_key", F.col("value").alias("base"))
    joined = base.join(mine, ["entity_id", "wire_key"], "full").join(fill, ["entity_id", "wire_key"], "full")
    return joined.select("entity_id", "wire_key", F.coalesce("reading", "base", "extra").alias("value"))


def missing_keys(record: DataFrame) -> DataFrame:
    """(entity_id, missing): the wire keys that an entity's record lacks, sorted; entities whose record is whole are left out."""
    every = F.array(*(F.lit(k) for k in sorted(WIRE_KEYS.values())))
    have = record.groupBy("entity_id").agg(F.collect_set("wire_key").alias("have"))
    return have.select("entity_id", F.array_except(every, F.col("have")).alias("missing")).where(F.size("missing") > 0)


def valueless(status: Column) -> Column:
    return status.isin(*VALUELESS)
