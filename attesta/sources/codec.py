"""The wire form of a collection: base64 of a JSON object from ids to records with short keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.domain import VALUELESS, WIRE_KEYS, is_accepted, wire_keys
from attesta.functions.text import stripped
from attesta.operators.snapshots import Snapshot, overlay


def decoded(text: Column) -> Column:
    """The JSON of a wire text; null unless it is strict base64 of UTF-8 JSON.  White space around it is no error."""
    raw = F.try_to_binary(stripped(text), F.lit("base64"))
    return F.try_parse_json(F.try_validate_utf8(raw.cast("string")))


def records(collections: DataFrame) -> DataFrame:
    """(source, entity, wire_key, kind, value, text): one row an entry of each record of (source, text); ``kind`` is the JSON type
    before any cast, so 5, 5.0, true and "5" stay apart; an entity whose record has no entries has a null key."""
    spark = collections.sparkSession
    view = "attesta_wire_" + str(abs(hash(tuple(collections.columns))))
    collections.select("source", decoded(F.col("text")).alias("data")).createOrReplaceTempView(view)
    return spark.sql(
        f"""
        SELECT w.source, e.key AS entity, f.key AS wire_key, schema_of_variant(f.value) AS kind,
               try_variant_get(f.value, '$', 'bigint') AS value, to_json(f.value) AS text
        FROM {view} w, LATERAL variant_explode(w.data) e LEFT JOIN LATERAL variant_explode_outer(e.value) f
        """
    )


def problems(collections: DataFrame) -> DataFrame:
    """(source, problem) of texts that are no collection, with the first thing that is wrong."""
    from attesta.operators.quality import wire_records

    bad = collections.select("source", decoded(F.col("text")).alias("data")).where(F.col("data").isNull() | ~F.schema_of_variant("data").startswith("OBJECT"))
    broken = records(collections)
    inner = wire_records(broken).select("key", "detail").distinct()
    found = broken.join(inner, (broken["entity"] == inner["key"]) & broken["wire_key"].eqNullSafe(inner["detail"])).select("source", F.concat_ws(" ", F.lit("invalid value"), "entity", "wire_key").alias("problem"))
    return bad.select("source", F.lit("not a collection").alias("problem")).unionByName(found.distinct())


def from_wire(collections: DataFrame, names: DataFrame | None = None) -> Snapshot:
    """The snapshot of a wire collection: mapped keys become imported readings, the rest extensions; ``names`` are (id, name)."""
    rows = records(collections)
    keyed = rows.withColumns({"entity_id": F.col("entity").try_cast("long"), "key": F.concat(F.lit("entity_"), F.col("entity").try_cast("long").cast("string"))})
    mapped = keyed.join(F.broadcast(wire_keys(rows.sparkSession)), "wire_key")  # 16 rows
    digest = collections.select("source", F.sha2(stripped(F.col("text")), 256).alias("sha256"))
    source = F.array(F.struct(F.lit("wire-collection").alias("kind"), F.col("source").alias("uri"), F.to_json(F.struct("sha256")).alias("details")))
    empty = F.lit("imported").alias("status")
    readings = mapped.join(digest, "source").select("key", "entity_id", "field", "value", empty, source.alias("sources"))
    other = F.when(F.col("wire_key").isNotNull() & ~F.col("wire_key").isin(*WIRE_KEYS.values()), F.struct("wire_key", "text"))
    entities = keyed.join(digest, "source").groupBy("key", "entity_id", "source", "sha256").agg(F.map_from_entries(F.collect_list(other)).alias("extensions"))
    if names is not None:
        entities = entities.join(names.select(F.col("id").alias("entity_id"), "name"), "entity_id", "left")
        name = F.coalesce("name", F.raise_error(F.concat(F.lit("unknown id: "), F.col("entity_id").cast("string"))))
    else:
        name = F.lit("")
    return Snapshot(entities.select("key", "entity_id", name.alias("name"), F.lit("imported").alias("identity_status"), "extensions", source.alias("sources")), readings)


def to_wire(records_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, text): for each account the base64 of the JSON object of its (entity_id, wire_key, text), entities and keys in order,
    without the line breaks that base64 has by default.  An account has a few hundred records."""
    by = by or []
    record = records_.groupBy(*by, "entity_id").agg(F.array_sort(F.collect_list(F.struct("wire_key", "text"))).alias("e"))
    name = lambda x: F.to_json(F.array(x["wire_key"]))
    entry = lambda x: F.concat(name(x).substr(F.lit(2), F.length(name(x)) - 2), F.lit(":"), x["text"])
    body = F.concat(F.lit('"'), F.col("entity_id").cast("string"), F.lit('":{'), F.array_join(F.transform("e", entry), ","), F.lit("}"))
    whole = record.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("entity_id", body.alias("b")))).alias("all"))
    json = F.concat(F.lit("{"), F.array_join(F.transform("all", lambda x: x["b"]), ","), F.lit("}"))
    return whole.select(*by, F.regexp_replace(F.base64(F.encode(json, "UTF-8")), r"\s", "").alias("text"))


def export(snapshot: Snapshot, baseline: DataFrame | None = None, *, allow_observed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(text, report): the wire text of a snapshot over a baseline (source, text), and one row (key, entity_id, outcome, missing)
    for each entity of the snapshot.

    Accepted readings overwrite the baseline, extensions fill; a record that lacks a key leaves the baseline's entry as it is;
    ``lock`` is false where nothing says otherwise; entities of the baseline alone stay.  Without any whole record the text's
    query stops."""
    spark = snapshot.entities.sparkSession
    base = records(baseline).where("wire_key is not null") if baseline is not None else None
    schema = "entity_id long, wire_key string, text string"
    base = base.select(F.col("entity").cast("long").alias("entity_id"), "wire_key", "text") if base is not None else spark.createDataFrame([], schema)
    ok = F.col("entity_id").isNotNull() & is_accepted("identity_status", allow_observed)
    known = snapshot.entities.where(ok)
    readings = snapshot.readings.join(known.select("entity_id"), "entity_id", "left_semi")
    mine = overlay(readings, base.limit(0).select("entity_id", "wire_key", F.lit(0).cast("long").alias("value")), base.limit(0).select("entity_id", "wire_key", F.lit(0).cast("long").alias("value")), allow_observed=allow_observed)
    extras = known.select("entity_id", F.explode("extensions").alias("wire_key", "text")).where(~F.col("wire_key").isin(*WIRE_KEYS.values()))
    level = lambda d, n: d.select("entity_id", "wire_key", "text", F.lit(n).alias("level"))
    layers = level(mine.withColumn("text", F.col("value").cast("string")), 0).union(level(base.join(known.select("entity_id"), "entity_id", "left_semi"), 1)).union(level(extras, 2)).union(level(known.select("entity_id", F.lit("lock").alias("wire_key"), F.lit("false").alias("text")), 3))
    merged = layers.groupBy("entity_id", "wire_key").agg(F.min_by("text", "level").alias("text"))
    lacking = known.select("entity_id").join(merged.groupBy("entity_id").agg(F.collect_set("wire_key").alias("have")), "entity_id", "left")
    lacking = lacking.select("entity_id", F.array_except(F.array(*map(F.lit, sorted(WIRE_KEYS.values()))), F.col("have")).alias("missing"))
    whole = lacking.where(F.size("missing") == 0).select("entity_id")
    final = merged.join(whole, "entity_id", "left_semi").union(base.join(whole, "entity_id", "left_anti").select("entity_id", "wire_key", "text"))
    text = to_wire(final).crossJoin(whole.agg(F.count(F.lit(1)).alias("updated")))  # one row each
    text = text.select(F.when(F.col("updated") > 0, F.col("text")).otherwise(F.raise_error(F.lit("no complete accepted record to export"))).alias("text"))
    outcome = F.when(~ok, "identity not confirmed").when(F.size("missing") > 0, "incomplete record").otherwise("updated")
    report = snapshot.entities.join(lacking, "entity_id", "left").select("key", "entity_id", outcome.alias("outcome"), F.when(ok, F.col("missing")).alias("missing"))
    return text, report


def from_extraction(rows: DataFrame) -> Snapshot:
    """The snapshot of consensus results: evidence images become sources, values and statuses stay."""
    source = lambda x: F.struct(F.lit("image").alias("kind"), x.alias("uri"), F.lit(None).cast("string").alias("details"))
    entities = rows.select("key", "entity_id", "name", "identity_status", F.create_map().cast("map<string,string>").alias("extensions"), F.transform("screenshots", source).alias("sources")).dropDuplicates(["key"])
    readings = rows.where("field is not null").select("key", "entity_id", "field", F.when(~F.col("status").isin(*VALUELESS), F.col("value")).alias("value"), "status", F.transform("images", source).alias("sources"))
    return Snapshot(entities, readings)
