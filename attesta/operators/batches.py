"""Ordered batches of inputs: hashes, keep-first de-duplication, fingerprints, manifests and catalogues of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import is_identifier, natural_key, safe_name
from attesta.scratch import written


def positions(rows: DataFrame, order: list[Column], column: str, pieces: int | None = None) -> DataFrame:
    """``rows`` with their places from 0 in a global order: rows are dealt by ranges of the order, counted by piece, and numbered
    inside their piece from where it starts, so no task sees more than a range of them.  The pieces are written once: ranges that
    are drawn again need not be the same."""
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_order{i}" for i in range(len(order))]
    keyed = written(rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(pieces, *keys).withColumn("_piece", F.spark_partition_id()), "ranges")
    counts = keyed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select("_piece", F.coalesce(F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a piece
    own = F.row_number().over(Window.partitionBy("_piece").orderBy(*keys)) - 1
    return keyed.withColumn("_own", own).join(F.broadcast(bases), "_piece").withColumn(column, (F.col("_base") + F.col("_own")).cast("long")).drop("_piece", "_own", "_base", *keys)


def numbered(rows: DataFrame, name: str = "name") -> DataFrame:
    """Rows in natural order of their names, with an ordinal from 0."""
    return positions(rows, [natural_key(F.col(name)), F.col(name)], "ordinal")


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def keep_first(rows: DataFrame, digest: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded): of rows with the same content the first stays.

    The first place of each content is a grouped minimum, so a content that fills most of the table isn't sorted in one task."""
    first = rows.groupBy(digest).agg(F.min(order).alias("_first"))
    joined = rows.join(first, digest)
    return joined.where(F.col(order) == F.col("_first")).drop("_first"), joined.where(F.col(order) != F.col("_first")).drop("_first")


def fingerprint(rows: DataFrame, by: list[str], digest: str, order: str) -> DataFrame:
    """(*by, fingerprint): hash of the digests of each batch in order; another order gives another fingerprint."""
    listed = F.array_sort(F.collect_list(F.struct(order, digest)))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x[digest]), ","), 256).alias("fingerprint"))


def canonical_hash(entries: Column) -> Column:
    """Hash of a map of strings that doesn't depend on the order of its entries."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))), 256)


def revision(parts: DataFrame, order: str = "name", digest: str = "sha256") -> DataFrame:
    """One row (revision): a hash of the parts' digests in order, so a change of any part, or of their order, changes it.  For the
    few files that one configuration consists of."""
    listed = F.array_sort(F.collect_list(F.struct(order, digest)))
    return parts.agg(F.sha2(F.array_join(F.transform(listed, lambda x: x[digest]), ""), 256).alias("revision"))


def sample_targets(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """(idx, image): the path that each chosen sample is written to; samples nobody chose go."""
    return samples.join(targets.select("idx", "image"), "idx").select("idx", "image")


def bad_timestamps(rows: DataFrame, column: str = "timestamp") -> DataFrame:
    """Timestamps that aren't finite or are negative."""
    t = F.col(column)
    return rows.where(t.isNotNull() & (F.isnan(t) | (t < 0) | (t == float("inf"))))


def manifest_differences(listed: DataFrame, present: DataFrame) -> DataFrame:
    """(name, state) where a manifest and the files don't agree: missing, unlisted or changed."""
    a, b = listed.select("name", F.col("sha256").alias("_want")), present.select("name", F.col("sha256").alias("_have"))
    state = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unlisted").when(F.col("_want") != F.col("_have"), "changed")
    return a.join(b, "name", "full").select("name", state.alias("state")).where("state is not null")


def manifest_problems(files: DataFrame, required: tuple[str, ...] = (), most_files: int = 4096, most_bytes: int = 512 << 20) -> DataFrame:
    """(rule, detail) of every rule that a bundle's files, (name, size), break."""
    spark = files.sparkSession
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    limits = total.select(F.explode(F.array_compact(F.array(F.when(~F.col("n").between(1, most_files), "file count"), F.when(F.col("bytes") > most_bytes, "total size")))).alias("rule")).withColumn("detail", F.lit(""))
    names = files.where(~safe_name(F.col("name"))).select(F.lit("unsafe name").alias("rule"), F.col("name").alias("detail"))
    cases = files.groupBy(F.lower("name").alias("detail")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("names differ by case only").alias("rule"), "detail")
    out = limits.unionByName(names).unionByName(cases)
    if required:
        want = spark.createDataFrame([(r,) for r in required], "name string")
        out = out.unionByName(want.join(files.select("name"), "name", "left_anti").select(F.lit("required file is missing").alias("rule"), F.col("name").alias("detail")))
    return out


def nested_names(rows: DataFrame, slots: list[Column]) -> DataFrame:
    """Distinct safe names in several places of each row, in order."""
    return rows.select(F.explode(F.array(*slots)).alias("name")).where(F.col("name").isNotNull() & is_identifier(F.col("name"))).distinct().orderBy("name")


def fetch_misses(wanted: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    return wanted.join(fetched.select(key).distinct(), key, "left_anti")


def category_totals(items: DataFrame) -> DataFrame:
    """(category, cells, known, quantity): unknown quantities are counted but add nothing."""
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("cells"), F.count("quantity").alias("known"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"))


def augmented(rows: DataFrame, copies: int, validation: float = 0.2) -> DataFrame:
    """``copies`` numbered variants of each row, with a split that only depends on the row's key and the variant."""
    made = rows.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    share = F.pmod(F.xxhash64("key", "variant"), F.lit(1_000_000)) / 1e6
    return made.withColumn("split", F.when(share < validation, "validation").otherwise("train"))
