"""More operators as queries: codecs, ordered aggregates, text and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import collections, numbers, text
from attesta.operators import batches, evaluation, ranking, scans, timeline
from attesta.plans import standins as s
from attesta.plans.queries import _EV, _SCORES, _scores, query
from attesta.sources import codec


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.array_join(collections.ordered_distinct("turn", "role"), ",").alias("roles"))


@query("SELECT conv_id, arg_min(t, turn) FILTER (WHERE t <> '') AS text FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS t FROM conversations) GROUP BY conv_id")
def first_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s.table(spark, sf_dir, "conversations").withColumn("t", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")))
    return c.groupBy("conv_id").agg(collections.first_non_empty("t", "turn").alias("text"))


@query("SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS entries FROM (SELECT user_id, event_type, CAST(arg_max(event_id, event_id) AS VARCHAR) AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def map_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.table(spark, sf_dir, "events").select("user_id", "event_id", F.create_map("event_type", F.col("event_id").cast("string")).alias("entries"))
    out = collections.united_maps(e, ["user_id"], "event_id", "entries")
    return out.select("user_id", F.array_join(F.transform(F.map_entries("entries"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("entries"))


@query("SELECT o_custkey, k AS o_orderkey, st AS o_orderstatus FROM (SELECT o_custkey, unnest(list(o_orderkey ORDER BY o_orderkey)) AS k, unnest(list(o_orderstatus ORDER BY o_orderkey)) AS st FROM orders GROUP BY o_custkey)")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders")
    sorted_ = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    lists = o.groupBy("o_custkey").agg(F.transform(sorted_, lambda x: x["o_orderkey"].cast("string")).alias("k"), F.transform(sorted_, lambda x: x["o_orderstatus"]).alias("st"))
    z = lists.select("o_custkey", F.explode(collections.zipped(F.col("k"), F.col("st"))).alias("z"))
    return z.select("o_custkey", F.col("z")[z.schema["z"].dataType.names[0]].cast("long").alias("o_orderkey"), F.col("z")[z.schema["z"].dataType.names[1]].alias("o_orderstatus"))


@query("SELECT a.s_suppkey, b.s_suppkey AS peer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def same_entity_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.peers(s.table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")


@query(f"WITH {_EV} SELECT event_id FROM ev WHERE k % 4 = 1 OR (k % 4 = 3 AND event_id % 2 = 0)")
def evidence_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    methods = F.array_compact(F.array(F.when(k % 4 == 1, "fallback"), F.when((k % 4 == 3) & (F.col("event_id") % 2 == 0), "fallback"), F.lit("primary")))
    e = s.events(spark, sf_dir).withColumn("evidence", F.transform(methods, lambda m: F.struct(m.alias("method"))))
    return e.where(collections.has_method(F.col("evidence"), "fallback")).select("event_id")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%'")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "part").where(collections.matches_search(F.col("p_name"), "RING")).select("p_partkey")


@query("SELECT event_id, strftime(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at_utc FROM events")
def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = s.epoch_seconds()
    # without the session's time zone: the local date and time of the epoch second
    at = F.date_format(F.expr("timestampadd(SECOND, timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts), timestamp_ntz'1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return s.table(spark, sf_dir, "events").select("event_id", F.when(seconds > 0, at).alias("at_utc"))


@query("SELECT vec_id AS idx, round(coalesce(list_sum(list_transform(list_zip(e, p), lambda z: abs(z[1] - z[2]))) / 64, 0.0), 6) AS motion FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (ORDER BY vec_id) AS p FROM embeddings)")
def motion_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = s.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("signature"))
    return timeline.motion(scans.by_ranges(v, [], "idx")).select("idx", F.round("motion", 6).alias("motion"))


@query(
    f"""WITH {_SCORES}, b AS (SELECT query, value, label, max(score) AS score FROM scores GROUP BY ALL), r AS (SELECT query, value, label, row_number() OVER (PARTITION BY query ORDER BY score DESC, label) AS n FROM b),
q AS (SELECT query, coalesce(min(n) FILTER (WHERE label = CAST(value AS VARCHAR)), 999) AS at FROM r GROUP BY query) SELECT round(avg(CASE WHEN at <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN at <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3, round(avg(CASE WHEN at <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5 FROM q""".replace(" AS at ", " AS pos ").replace("WHEN at <=", "WHEN pos <=")
)
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, _ = s.vectors(spark, sf_dir)
    best = ranking.best_per_label(_scores(spark, sf_dir, by_label=True))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "label")))
    ranked = best.groupBy("query").agg(F.transform(order, lambda x: x["label"]).alias("ranked")).join(asks.select("query", F.col("value").cast("string").alias("label")), "query")
    return evaluation.top_k_accuracy(ranked).select(*(F.round(c, 6).alias(c) for c in ("top1", "top3", "top5")))


@query("SELECT p_partkey, CAST(p_size * 0.5 + (p_partkey % 100) * 2 + 3 AS DOUBLE) AS x, CAST(p_size * -1.5 + (p_partkey % 100) * 0.25 - 7 AS DOUBLE) AS y FROM part")
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = F.array(*map(F.lit, (0.5, 2.0, 3.0, -1.5, 0.25, -7.0)))
    p = s.table(spark, sf_dir, "part").select("p_partkey", numbers.affine(F.col("p_size"), F.col("p_partkey") % 100, matrix).alias("p"))
    return p.select("p_partkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("SELECT p_partkey, replace(replace(p_brand, '#', '#'), ' ', ' ') || '_' AS name, CAST(p_partkey AS VARCHAR) AS digits FROM part")
def clean_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = s.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.clean_filename(F.concat("p_brand", F.lit("?. "))).alias("name"), text.padded("", F.col("p_partkey"), 1).alias("digits"))


@query("SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(url, '^[A-Za-z]+://', ''), '/', '_'), ':', '_'), '?', '_'), '&', '_'), '=', '_') AS name FROM pages")
def url_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "pages").select("page_id", text.flat_filename(F.col("url")).alias("name"))


@query("SELECT user_id, sha256('{' || string_agg('\"' || event_type || '\":\"' || n || '\"', ',' ORDER BY event_type) || '}') AS digest FROM (SELECT user_id, event_type, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = s.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("string").alias("n"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", batches.canonical_hash(F.col("m")).alias("digest"))


_WIRE = """w AS (SELECT c_nationkey AS source, to_base64(encode('{' || string_agg('"' || CAST(c_custkey + 1 AS VARCHAR) || '":{"l":' || CAST(c_custkey % 101 AS VARCHAR) || ',"note":"' || c_mktsegment || '","s":' || CAST(c_custkey % 5 AS VARCHAR) || '}', ',' ORDER BY c_custkey) || '}')) AS text FROM customer GROUP BY c_nationkey)"""


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s.table(spark, sf_dir, "customer")
    rows = c.select("c_nationkey", (F.col("c_custkey") + 1).alias("entity_id"), F.explode(F.create_map(F.lit("l"), (F.col("c_custkey") % 101).cast("string"), F.lit("s"), (F.col("c_custkey") % 5).cast("string"), F.lit("note"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))).alias("wire_key", "text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wire_key", "text"))), lambda x: F.concat(F.lit('"'), x["wire_key"], F.lit('":'), x["text"])), ",")
    record = rows.groupBy("c_nationkey", "entity_id").agg(body.alias("b"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "b"))), lambda x: F.concat(F.lit('"'), x["entity_id"].cast("string"), F.lit('":{'), x["b"], F.lit("}"))), ",")
    json = record.groupBy(F.col("c_nationkey").cast("string").alias("source")).agg(F.concat(F.lit("{"), whole, F.lit("}")).alias("j"))
    return json.select("source", F.base64(F.encode("j", "UTF-8")).alias("text"))


@query("SELECT c_custkey + 1 AS entity_id, CASE f WHEN 1 THEN 'level' ELSE 'star' END AS field, CASE f WHEN 1 THEN c_custkey % 101 ELSE c_custkey % 5 END AS value, 'imported' AS status FROM customer, (SELECT unnest([1, 2]) AS f)")
def wire_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.from_wire(_wire(spark, sf_dir)).readings.select("entity_id", "field", "value", "status")


@query("SELECT c_custkey + 1 AS entity_id, 'note' AS key, '\"' || c_mktsegment || '\"' AS value FROM customer")
def wire_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.from_wire(_wire(spark, sf_dir)).entities.select("entity_id", F.explode("extensions"))


@query(f"WITH {_WIRE} SELECT CAST(source AS VARCHAR) AS source, text FROM w")
def wire_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codec.records(_wire(spark, sf_dir))
    return codec.to_wire(rows.select("source", F.col("entity").cast("long").alias("entity_id"), "wire_key", "text"), ["source"])


@query("SELECT c_nationkey % 3 AS kind, count(DISTINCT c_nationkey) AS n FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1")
def wire_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the texts is good, a third isn't base64, a third has a value of the wrong type."""
    w, kind = _wire(spark, sf_dir), F.col("source").cast("long") % 3
    bad = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat("text", F.lit("\n!"))).otherwise(F.base64(F.encode(F.lit('{"1":{"l":true}}'), "UTF-8")))
    found = codec.problems(w.withColumn("text", bad)).select("source").distinct()
    return found.groupBy((F.col("source").cast("long") % 3).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH m AS (SELECT user_id, CAST(event_id AS DOUBLE) AS mark FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, CAST(event_id AS DOUBLE) AS t FROM events WHERE event_type <> 'purchase'),
b AS (SELECT p.*, m.mark AS b FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.t >= m.mark), a AS (SELECT b.*, m.mark AS a FROM b ASOF LEFT JOIN m ON b.user_id = m.user_id AND b.t <= m.mark)
SELECT user_id, t, CASE WHEN b IS NULL OR a - t < t - b THEN a ELSE b END AS mark FROM a"""
)
def nearest_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each other event of a user the purchase that is nearest by id."""
    e = s.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").cast("double").alias("t"))
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("mark"))
    return timeline.nearest(e.where("event_type <> 'purchase'").select("user_id", "t"), marks, ["user_id"]).select("user_id", "t", "mark")


@query("SELECT l_returnflag, round(CAST(sum(CAST(round(l_discount * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = s.table(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_discount") * 100).cast("long").alias("v"), F.col("l_quantity").cast("long").alias("w"))
    return li.groupBy("l_returnflag").agg(F.round(evaluation.weighted_mean("v", "w"), 6).alias("mean"))


@query(
    """WITH v AS (SELECT p_partkey, p_size, p_partkey % 7 AS tier FROM part), c AS (SELECT unnest(range(0, 5)) AS icon, unnest([NULL, 1, 2, 3, NULL]) AS icon_tier)
SELECT p_partkey, icon FROM v, c WHERE icon_tier IS NULL OR icon_tier = CASE WHEN tier = 0 THEN icon_tier ELSE tier END"""
)
def tier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = s.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 7).alias("tier"))
    icons = spark.createDataFrame([(0, None), (1, 1), (2, 2), (3, 3), (4, None)], "icon long, icon_tier long")
    return cells.crossJoin(F.broadcast(icons)).where(ranking.tier_consistent(F.col("icon_tier"), F.col("tier"))).select("p_partkey", "icon")  # five icons
