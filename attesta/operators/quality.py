"""The constraints of the data model as tables of violations (rule, key, detail): empty where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.domain import STATUSES, VALUELESS, WIRE_KEYS, bounds
from attesta.operators.batches import bad_timestamps, manifest_problems

__all__ = ["bad_timestamps", "manifest_problems"]


def _violations(df: DataFrame, rule: str, key: Column, detail: Column, bad: Column) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(True))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def value_status(readings: DataFrame) -> DataFrame:
    """A status says that there is no value exactly if there is none; statuses are of the domain."""
    without = F.col("status").isin(*VALUELESS)
    return _violations(readings, "value and status", F.col("key"), F.col("field"), (without != F.col("value").isNull()) | ~F.col("status").isin(*STATUSES))


def field_bounds(readings: DataFrame) -> DataFrame:
    """Fields are known and values within their bounds."""
    joined = readings.join(F.broadcast(bounds(readings.sparkSession)), "field", "left")
    return _violations(joined, "field bounds", F.col("key"), F.col("field"), F.col("low").isNull() | ~F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(True)))


def identity(entities: DataFrame) -> DataFrame:
    """Without an id the identity is unknown or in conflict; ids are positive."""
    bad = (F.col("entity_id").isNull() & ~F.col("identity_status").isin(*VALUELESS)) | F.coalesce(F.col("entity_id") <= 0, F.lit(False))
    return _violations(entities, "identity", F.col("key"), F.col("identity_status"), bad)


def unique(entities: DataFrame) -> DataFrame:
    """Ids and keys stand once."""
    twice = lambda c: entities.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(f"duplicate {c}").alias("rule"), F.col(c).cast("string").alias("key"), F.col("n").cast("string").alias("detail"))
    return twice("entity_id").unionByName(twice("key"))


def scanned_cells(cells: DataFrame) -> DataFrame:
    """An exact quantity has a number and no other does; tiers and confidences are in range."""
    bad = ((F.col("quantity_status") == "exact") != F.col("quantity").isNotNull()) | F.coalesce(F.col("quantity") < 0, F.lit(False)) | ~F.coalesce(F.col("tier").between(0, 10), F.lit(True)) | ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(True))
    return _violations(cells, "scanned cell", F.concat_ws(",", "row", "col"), F.col("quantity_status"), bad)


def paired_lists(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Two lists are both there or both absent, and of equal length."""
    return _violations(rows, f"{a} and {b}", F.col(key), F.lit(""), (F.col(a).isNull() != F.col(b).isNull()) | F.coalesce(F.size(a) != F.size(b), F.lit(False)))


def wire_records(records: DataFrame) -> DataFrame:
    """(entity, wire_key, kind, value) of decoded records: keys are digits, known short keys whole numbers of 0..100."""
    known = F.col("wire_key").isin(*WIRE_KEYS.values())
    bad = ~F.col("entity").rlike(r"\A[0-9]+\z") | (known & (~F.coalesce(F.col("kind") == "BIGINT", F.lit(False)) | ~F.coalesce(F.col("value").between(0, 100), F.lit(False))))
    return _violations(records, "wire record", F.col("entity"), F.col("wire_key"), bad)


def payloads(rows: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """A payload (url, kind, body) isn't empty or too large and is what its kind says."""
    hexed = F.hex(F.substring("body", 1, 12))
    end = F.hex(F.expr("substring(body, greatest(1, octet_length(body) - 11), 12)"))
    image = (hexed.startswith("89504E470D0A1A0A") & end.endswith("49454E44AE426082")) | (hexed.startswith("FFD8FF") & end.endswith("FFD9")) | (hexed.startswith("52494646") & hexed.endswith("57454250"))
    json = F.coalesce(F.schema_of_variant(F.try_parse_json(F.decode("body", "UTF-8"))).startswith("OBJECT"), F.lit(False))
    size = F.octet_length("body")
    return _violations(rows, "payload", F.col("url"), F.col("kind"), (size == 0) | (size > most_bytes) | ~F.when(F.col("kind") == "json", json).otherwise(image))


def unexpected_keys(rows: DataFrame, key: str, json: str, allowed: tuple[str, ...]) -> DataFrame:
    """(rule, key, detail): keys of a JSON object that its model doesn't have."""
    extra = F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(extra).alias("detail")).select(F.lit("unexpected key").alias("rule"), "key", "detail")


def catalogue_rows(rows: DataFrame) -> DataFrame:
    """Every entry has a name and an id."""
    return _violations(rows, "catalogue entry", F.col("id"), F.col("name"), F.col("id").isNull() | F.col("name").isNull() | (F.col("name") == ""))


def settings(values: dict[str, float]) -> list[str]:
    """Names of settings out of range: durations are finite and not negative, a retry waits a second at least."""
    return [k for k, v in values.items() if isinstance(v, bool) or not 0 <= v < float("inf") or (k == "retry_delay" and v < 1)]


def threshold_ok(value: object) -> bool:
    return not isinstance(value, bool) and isinstance(value, int | float) and 0 <= value <= 1


def snapshot_violations(entities: DataFrame, readings: DataFrame) -> DataFrame:
    return value_status(readings).unionByName(field_bounds(readings)).unionByName(identity(entities)).unionByName(unique(entities))
