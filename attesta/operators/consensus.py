"""Consensus over noisy readings: what repeated, possibly conflicting observations of an entity agree on.

Rows are one per (observation, field): key, observation, entity_id, name, screenshots, field, value, status, images.  An
observation without fields has one row with a null field.  The result has the same columns, so it can be judged again on
another key.  A value is confirmed by two images, never by a majority; a conflict gives no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.scratch import written

COLUMNS = ["key", "observation", "entity_id", "name", "screenshots", "field", "value", "status", "images"]


def _union(arrays: Column) -> Column:
    """Distinct members of many arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(arrays)))


def identities(rows: DataFrame) -> DataFrame:
    """(key, entity_id, name, identity_status, screenshots, observations) of each key."""
    known = F.col("entity_id").isNotNull()
    seen = rows.groupBy("key").agg(
        F.min("entity_id").alias("low"),
        F.max("entity_id").alias("high"),
        F.min_by(F.when(known, F.col("name")), F.when(known, F.col("observation"))).alias("known_name"),
        F.min_by("name", "observation").alias("first_name"),
        _union(F.collect_set(F.when(known, F.col("screenshots")))).alias("supporting"),
        _union(F.collect_set("screenshots")).alias("screenshots"),
        F.count_distinct("observation").alias("observations"),
    )
    one, none = F.col("low") == F.col("high"), F.col("low").isNull()
    status = F.when(none, "unknown").when(~one, "conflict").when(F.size("supporting") >= 2, "confirmed").otherwise("observed")
    return seen.select("key", F.when(one, F.col("low")).alias("entity_id"), F.when(one, F.col("known_name")).otherwise(F.col("first_name")).alias("name"), status.alias("identity_status"), "screenshots", "observations")


def consensus(rows: DataFrame) -> DataFrame:
    """(key, entity_id, name, identity_status, screenshots, observations, field, value, status, images).

    Fields of a key come from all its rows, but only readings of the agreed entity count, if one is agreed on.  Both
    aggregations are on the key, so one exchange serves them and the join."""
    found = identities(rows)
    counts = F.col("agreed").isNull() | (F.col("entity_id") == F.col("agreed"))
    valued = counts & F.col("value").isNotNull()
    fields = (
        rows.where(F.col("field").isNotNull())
        .join(found.select("key", F.col("entity_id").alias("agreed")), "key")
        .groupBy("key", "field")
        .agg(
            F.min(F.when(valued, F.col("value"))).alias("low"),
            F.max(F.when(valued, F.col("value"))).alias("high"),
            F.coalesce(F.bool_or(F.when(counts, F.col("status") == "conflict")), F.lit(False)).alias("conflicting"),
            F.coalesce(F.bool_and(F.when(valued, F.col("status") == "inferred")), F.lit(False)).alias("inferred"),
            _union(F.collect_set(F.when(valued, F.col("images")))).alias("supporting"),
            _union(F.collect_set(F.when(counts, F.col("images")))).alias("images"),
        )
    )
    conflict = F.col("conflicting") | (F.col("low") < F.col("high"))
    status = F.when(conflict, "conflict").when(F.col("low").isNull(), "unknown").when(F.size("supporting") >= 2, "confirmed").when(F.col("inferred"), "inferred").otherwise("observed")
    judged = fields.select("key", "field", F.when(~conflict, F.col("low")).alias("value"), status.alias("status"), "images")
    return found.join(judged, "key", "left")


def final_key(entity_id: Column, key: Column) -> Column:
    """Identified visits meet under their entity; each unidentified one stays by itself."""
    return F.coalesce(F.concat(F.lit("entity_"), entity_id.cast("string")), key)


def merged_visits(visits: DataFrame) -> DataFrame:
    """The results of ``consensus`` by visit, judged again by entity; an entity of one visit keeps that result unchanged.  The
    visits are read three times, so they are written once."""
    keyed = written(visits.withColumn("visit", F.col("key")).withColumn("key", final_key(F.col("entity_id"), F.col("key"))), "visits")
    counts = keyed.groupBy("key").agg(F.count_distinct("visit").alias("visits"))
    keyed = keyed.join(counts, "key")
    single = keyed.where("visits = 1").select("key", "entity_id", "name", "identity_status", "screenshots", F.lit(1).cast("long").alias("observations"), "field", "value", "status", "images")
    several = keyed.where("visits > 1").select("key", F.col("visit").alias("observation"), "entity_id", "name", "screenshots", "field", "value", "status", "images")
    return single.unionByName(consensus(several).select(single.columns))


def identified(entities: DataFrame) -> DataFrame:
    """One row: entities, and how many of them are identified."""
    return entities.agg(F.count_distinct("key").alias("entities"), F.count_distinct(F.when(F.col("entity_id").isNotNull(), F.col("key"))).alias("identified"))


def final_values(entities: DataFrame) -> DataFrame:
    """(key, entity_id, name, identity_status, fields): of each field only its value and status, without evidence."""
    pair = F.struct("field", F.struct("value", "status"))
    return entities.groupBy("key", "entity_id", "name", "identity_status").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), pair)))).alias("fields"))


def by_quality(qualities: DataFrame) -> DataFrame:
    """Observations of each key with their rank: those with more values first, else in their own order."""
    return qualities.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("quality"), "observation")))


def split_observations(rows: DataFrame, reasons: tuple[str, ...] = ("not_entity_screen", "layout_unresolved")) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows whose ``rejection`` is one of ``reasons`` never enter the consensus."""
    bad = F.coalesce(F.col("rejection").isin(*reasons), F.lit(False))
    return rows.where(~bad), rows.where(bad)


def status_histogram(readings: DataFrame) -> DataFrame:
    return readings.where("field is not null").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def review_queue(entities: DataFrame) -> DataFrame:
    """(key, entity_id, identity_status, n_fields, fields): what needs review before a strict export."""
    settled = ("confirmed", "corrected")
    open_ = F.col("field").isNotNull() & ~F.col("status").isin(*settled)
    found = entities.groupBy("key", "entity_id", "identity_status").agg(F.count_if(open_).alias("n_fields"), F.array_sort(F.collect_set(F.when(open_, F.col("field")))).alias("fields"))
    return found.where(_open(settled))


def _open(settled: tuple[str, ...] = ("confirmed", "corrected")) -> Column:
    return (F.col("n_fields") > 0) | ~F.col("identity_status").isin(*settled)


def review_summary(entities: DataFrame) -> DataFrame:
    """One row: entities, those that need review, and open fields."""
    open_ = F.col("field").isNotNull() & ~F.col("status").isin("confirmed", "corrected")
    found = entities.groupBy("key", "identity_status").agg(F.count_if(open_).alias("n_fields"))
    return found.agg(F.count(F.lit(1)).alias("entities"), F.count_if(_open()).alias("needing_review"), F.coalesce(F.sum("n_fields"), F.lit(0)).alias("open_fields"))


def frame_quality(rows: DataFrame) -> DataFrame:
    """(key, observation, quality): fields with a value, by observation."""
    return rows.groupBy("key", "observation").agg(F.count("value").alias("quality"))


def two_readers(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """Readings of two independent readers, (key, field, value): they agree, one fills the other, or they conflict."""
    a, b = F.col("a.value"), F.col("b.value")
    joined = primary.alias("a").join(alternate.alias("b"), ["key", "field"], "left")
    conflict = a.isNotNull() & b.isNotNull() & (a != b)
    return joined.select(
        "key",
        "field",
        F.when(~conflict, F.coalesce(a, b)).alias("value"),
        F.when(conflict, "conflict").when(F.coalesce(a, b).isNull(), "unknown").otherwise("observed").alias("status"),
        F.when(conflict, "disagreement").when(a.isNull() & b.isNotNull(), "fallback").otherwise("primary").alias("reader"),
    )


def chosen_reader(primary: DataFrame, alternate: DataFrame, choice: str = "auto") -> DataFrame:
    """Readings of one reader, or of both: ``primary`` or ``alternate`` alone, or ``auto`` for their agreement."""
    if choice == "auto":
        return two_readers(primary, alternate)
    if choice not in ("primary", "alternate"):
        raise ValueError(f"unknown reader: {choice}")
    status = F.when(F.col("value").isNull(), "unknown").otherwise("observed")
    return (primary if choice == "primary" else alternate).select("key", "field", "value", status.alias("status"), F.lit(choice).alias("reader"))


def agreed_view(views: DataFrame, by: list[str], least_score: float = 0.65) -> DataFrame:
    """Positional agreement of several views, (*by, parsed, score): all valid ones must give the same, the best score wins."""
    valid = F.col("parsed").isNotNull() & (F.col("score") >= least_score)
    found = views.groupBy(*by).agg(F.count_distinct(F.when(valid, F.col("parsed"))).alias("kinds"), F.max(F.when(valid, F.col("score"))).alias("best"), F.min(F.when(valid, F.col("parsed"))).alias("one"), F.count_if(valid).alias("valid_views"))
    agree = F.col("kinds") == 1
    return found.select(*by, F.when(agree, F.col("one")).alias("parsed"), F.when(agree, F.col("best")).otherwise(0.0).alias("score"), F.when(agree, "exact").when(F.col("kinds") > 1, "conflict").otherwise("unreadable").alias("status"), "valid_views")
