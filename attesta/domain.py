"""The closed domains of the data model: statuses, fields with their bounds, and the short keys of the wire format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values --------------------------------------------------------------------------------------------------
STATUSES = ("unknown", "observed", "inferred", "confirmed", "corrected", "conflict", "imported")
#: Statuses that a strict operation takes, and those that a caller can add.
ACCEPTED, OPTIONAL = ("confirmed", "corrected", "imported"), ("observed", "inferred")
#: Statuses that say that there is no value.
VALUELESS = ("unknown", "conflict")
BOUNDS = {
    "star": (1, 5),
    "level": (1, 100),
    "bond": (1, 100),
    "ex": (1, 5),
    "basic": (0, 10),
    "passive": (0, 10),
    "sub": (0, 10),
    "weapon_star": (0, 4),
    "weapon_level": (0, 100),
    "gear": (0, 2),
    "equipment1": (0, 20),
    "equipment2": (0, 20),
    "equipment3": (0, 20),
    "equipment1_level": (0, 100),
    "equipment2_level": (0, 100),
    "equipment3_level": (0, 100),
    "potential_hp": (0, 25),
    "potential_attack": (0, 25),
    "potential_heal": (0, 25),
}
WIRE_KEYS = {
    "star": "s",
    "level": "l",
    "bond": "b",
    "ex": "s1",
    "basic": "s2",
    "passive": "s3",
    "sub": "s4",
    "equipment1": "e1",
    "equipment2": "e2",
    "equipment3": "e3",
    "gear": "e4",
    "weapon_star": "ws",
    "weapon_level": "wl",
    "potential_hp": "pm",
    "potential_attack": "pa",
    "potential_heal": "ph",
}
#: Fields that the wire format can't leave locked: 0 is written as 1.
UNLOCKED = ("basic", "passive", "sub")
CATEGORIES = ("Campaign", "Bounty", "WeekDungeon", "SchoolDungeon")
SERVERS = ("Jp", "Global", "Cn")
CONDITIONS = ("FirstClear", "ThreeStar")
# --------------------------------------------------------------------------------------------------------------------

SOURCE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("details", T.StringType())])

#: One row an entity of a snapshot; entity_id is null where the entity isn't identified.
ENTITIES = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("entity_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("identity_status", T.StringType(), False),
        T.StructField("extensions", T.MapType(T.StringType(), T.StringType())),
        T.StructField("sources", T.ArrayType(SOURCE)),
    ]
)
#: One row a reading of a snapshot.
READINGS = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("entity_id", T.LongType()),
        T.StructField("field", T.StringType(), False),
        T.StructField("value", T.LongType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("sources", T.ArrayType(SOURCE)),
    ]
)


def accepted_statuses(allow_observed: bool = False) -> tuple[str, ...]:
    return ACCEPTED + OPTIONAL if allow_observed else ACCEPTED


def is_accepted(status: Column | str, allow_observed: bool = False) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return F.coalesce(status.isin(*accepted_statuses(allow_observed)), F.lit(False))


def bounds(spark: SparkSession, values: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(field, low, high), a table of a few rows."""
    return spark.createDataFrame([(k, *v) for k, v in (values or BOUNDS).items()], "field string, low long, high long")


def wire_keys(spark: SparkSession) -> DataFrame:
    """(field, wire_key)."""
    return spark.createDataFrame(list(WIRE_KEYS.items()), "field string, wire_key string")
