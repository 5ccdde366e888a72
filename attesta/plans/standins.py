"""Inputs of the operators, made from the tables of the test data: readings from events, stages and rewards from orders and
line items, and so on.  Only this module and ``queries`` know the names of those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.domain import CATEGORIES
from attesta.operators.rewards import multiplier
from attesta.operators.snapshots import Snapshot


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds() -> Column:
    """Epoch seconds of the events' local times, whatever the session's time zone."""
    return F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = events(spark, sf_dir), F.col("k")
    nothing = k % 11 == 0
    return e.select(
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("_"), F.col("user_id").cast("string")).alias("key"),
        F.col("event_id").alias("observation"),
        F.when(k % 13 == 0, None).when(k % 29 == 0, F.col("user_id") + 1000).otherwise(F.col("user_id")).alias("entity_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("name"),
        F.array(F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string"))).alias("screenshots"),
        F.col("event_type").alias("field"),
        F.when(~nothing, F.floor("value") % 3).alias("value"),
        F.when(nothing & (k % 2 == 0), "conflict").when(nothing, "unknown").when(k % 5 == 1, "inferred").otherwise("observed").alias("status"),
        F.array(F.concat(F.lit("i"), (F.col("event_id") % 7).cast("string"))).alias("images"),
    )


def snapshot(spark: SparkSession, sf_dir: str, late: bool) -> Snapshot:
    """The latest reading of each (user, event type) before or from 2024-01-16."""
    e, k = events(spark, sf_dir), F.col("k")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    half = e.where(F.col("ts") >= cut if late else F.col("ts") < cut)
    entity = F.concat(F.lit("entity_"), F.col("user_id").cast("string")).alias("key")
    no_sources = F.array().cast("array<struct<kind:string,uri:string,details:string>>").alias("sources")
    last = half.groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "k"), "event_id").alias("r"))
    k5 = F.col("r.k") % 7
    status = F.when(k5 == 0, "unknown").when(k5 == 1, "observed").when(k5 == 2, "inferred").when(k5 == 3, "confirmed").when(k5 == 4, "corrected").when(k5 == 5, "conflict").otherwise("imported")
    readings = last.select(entity, F.col("user_id").alias("entity_id"), F.col("event_type").alias("field"), F.when(~k5.isin(0, 5), F.floor("r.value") % 5).alias("value"), status.alias("status"), no_sources)
    mode = F.col("r.k") % 5
    identity = half.groupBy("user_id").agg(F.max_by(F.struct("k"), "event_id").alias("r")).where("user_id % 10 <> 7" if late else "user_id % 10 <> 3")
    who = F.when(mode == 0, "observed").when(mode == 1, "imported").when(mode == 2, "corrected").otherwise("confirmed")
    entities = identity.select(entity, F.col("user_id").alias("entity_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("name"), who.alias("identity_status"), F.create_map().cast("map<string,string>").alias("extensions"), no_sources)
    return Snapshot(entities, readings.join(entities.select("entity_id"), "entity_id", "left_semi"))


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reward a line item; the category of its stage by the order's priority; a third open a group of parts."""
    item, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part").select("p_partkey", (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long") * 100 + F.col("p_size")).alias("group_id"))
    stage = order.select("o_orderkey", F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.substring("o_orderpriority", 1, 1).cast("int") % 4) + 1).alias("category"), (F.col("o_orderkey") % 2).alias("difficulty"))
    percent = F.round(F.col("l_discount") * 100).cast("int")
    factor = multiplier(F.col("category"), F.col("difficulty"), normal=2.0, hard=3.0, bounty=2.0, school=4.0)
    grouped = F.col("l_linenumber") % 3 == 0
    joined = item.join(stage, item["l_orderkey"] == stage["o_orderkey"]).join(part, item["l_partkey"] == part["p_partkey"])
    return joined.select(
        F.col("l_orderkey").alias("stage_id"),
        "category",
        F.when(grouped, "GachaGroup").when(F.col("l_linenumber") % 3 == 1, "Item").otherwise("Equipment").alias("reward_kind"),
        F.when(grouped, F.col("group_id")).otherwise(F.col("l_partkey")).alias("reward_id"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("amount_min"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity") + 2).alias("amount_max"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity")).alias("amount"),
        F.when(percent != 5, percent / 10.0).alias("chance"),
        F.when(F.col("l_returnflag") == "R", "FirstClear").when(F.col("l_returnflag") == "A", "ThreeStar").alias("reward_type"),
        factor.alias("factor"),
    )


def group_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long") * 100 + F.col("p_size")).alias("group_id"), F.lit("Item").alias("item_type"), F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % 3).cast("double").alias("item_min"), (F.col("p_partkey") % 3 + 2).cast("double").alias("item_max"), ((F.col("p_partkey") % 5) / 4.0).alias("item_chance"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, signature): hourly means, in hundredths, of the events' values."""
    hour = F.floor(epoch_seconds() / 3600)
    e = events(spark, sf_dir).groupBy(hour.alias("hour")).agg(F.avg(F.round(F.col("value") * 100).cast("decimal(18,0)")).alias("mean"))
    first = e.agg(F.min("hour").alias("first"))
    return e.crossJoin(first).select((F.col("hour") - F.col("first")).cast("long").alias("idx"), F.round(F.col("mean").cast("double") / 1000, 3).alias("signature"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, gallery) of labelled vectors: every fifth one asks."""
    e = table(spark, sf_dir, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    asks = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("value"), "vector")
    return asks, e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("item"), F.col("label").cast("string").alias("label"), "vector")


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an evaluation from events: value, prediction, score and margin in hundredths, split, condition and family."""
    e, k = events(spark, sf_dir), F.col("k")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(
        F.col("event_id").alias("key"),
        F.when(k % 9 != 0, (k % 4).cast("long")).alias("value"),
        F.when(k % 10 != 3, F.when(cents % 5 == 0, (k + 1) % 4).otherwise(k % 4).cast("string")).alias("prediction"),
        ((cents % 51) + F.lit(50)).cast("double").alias("score100"),
        (((cents % 51) + 50) / 100.0).alias("score"),
        ((F.col("event_id") % 31) / 100.0).alias("margin"),
        F.when(F.col("user_id") % 2 == 0, "calibration").otherwise("test").alias("split"),
        F.when(k % 3 == 0, "clean").when(k % 3 == 1, "scaled").otherwise("blurred").alias("condition"),
        F.when(F.col("event_type") == "click", "level").when(F.col("event_type") == "view", "bond").when(F.col("event_type") == "signup", "tier").otherwise("skill").alias("family"),
    )


def cache_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache log: urls by user, bodies by value; each type of event is a status."""
    e = events(spark, sf_dir)
    status = F.when(F.col("event_type") == "click", "downloaded").when(F.col("event_type") == "view", "not-modified").when(F.col("event_type") == "purchase", "unchanged").when(F.col("event_type") == "signup", "adopted").otherwise("failed")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("https://host"), (F.col("user_id") % 4).cast("string"), F.lit(".example/"), F.col("user_id").cast("string")).alias("url"),
        F.when(F.col("user_id") % 3 == 0, "image").otherwise("json").alias("kind"),
        epoch_seconds().cast("double").alias("at"),
        status.alias("status"),
        F.when(status != "failed", F.sha2((F.floor("value") % 5).cast("string"), 256)).alias("sha256"),
        (F.floor("value") + 1).alias("size"),
        F.when(status == "failed", F.when(F.col("k") % 3 == 0, 429).when(F.col("k") % 3 == 1, 503).otherwise(404)).alias("http_status"),
        F.when(F.col("k") % 2 == 0, F.col("k").cast("double") * 10).alias("retry_after"),
    )
