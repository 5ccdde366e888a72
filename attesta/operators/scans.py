"""Scans over ordered rows whose key, or lack of one, would put them all in one task.

``by_ranges`` deals rows by ranges of (*by, order) into numbered pieces, which are written once.  A scan then runs inside each piece, each
piece gives one row of what it carries on (its last value, its number of rows), a window over those few rows combines them, and
what comes from the pieces before is applied to the rows of a piece.  Rows without the column ``PIECE`` are scanned by plain windows
over ``by``, which suits keys of moderate size.  Keys are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from attesta.scratch import written

PIECE = "_piece"


def plain_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of inputs that are dealt alike as dealt so itself and pairs their partitions.  Adaptive execution can
    change the partitions of one of them, and rows are then doubled or the query fails; without that claim the union is dealt anew."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def by_ranges(rows: DataFrame, by: list[str], order: str, pieces: int | None = None) -> DataFrame:
    """``rows`` with ``PIECE``; a later row of a key never has a smaller one."""
    plain_unions(rows.sparkSession)
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(pieces, *by, order).withColumn(PIECE, F.spark_partition_id()), "ranges")


def pieced(rows: DataFrame) -> list[str]:
    """The column of pieces, if there is one."""
    return [PIECE] if PIECE in rows.columns else []


def _window(rows: DataFrame, by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by, *pieced(rows)).orderBy(*order)


def _pieces(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(PIECE)  # one row a piece of a key


def beside(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, *, ahead: bool = False) -> DataFrame:
    """``rows`` with the value of the row before (``ahead``: after) each of a key; null at the end."""
    w, step = _window(rows, by, order), F.lead if ahead else F.lag
    if not pieced(rows):
        return rows.withColumn(name, step(value).over(w))
    end = (F.min_by if ahead else F.max_by)(F.struct(value.alias("v")), F.struct(*order))
    ends = rows.groupBy(*by, PIECE).agg(end.alias("_end"))
    ends = ends.select(*by, PIECE, step("_end").over(_pieces(by)).alias("_end"))
    own = rows.withColumns({name: step(value).over(w), "_edge": step(F.lit(True)).over(w).isNull()})
    found = own.join(ends, [*by, PIECE]).withColumn(name, F.when(F.col("_edge"), F.col("_end.v")).otherwise(F.col(name)))
    return found.select(*rows.columns, name)


def last_known(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last value that is not null up to each of a key, its own included."""
    own = rows.withColumn(name, F.last(value, ignorenulls=True).over(_window(rows, by, order).rowsBetween(Window.unboundedPreceding, 0)))
    if not pieced(rows):
        return own
    ends = rows.groupBy(*by, PIECE).agg(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("_end"))
    ends = ends.select(*by, PIECE, F.last("_end", ignorenulls=True).over(_pieces(by).rowsBetween(Window.unboundedPreceding, -1)).alias("_end"))
    return own.join(ends, [*by, PIECE]).withColumn(name, F.coalesce(name, "_end")).select(*rows.columns, name)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their places from 0 within each key."""
    own = rows.withColumn(name, (F.row_number().over(_window(rows, by, order)) - 1).cast("long"))
    if not pieced(rows):
        return own
    before = F.sum("_n").over(_pieces(by).rowsBetween(Window.unboundedPreceding, -1))
    bases = rows.groupBy(*by, PIECE).agg(F.count(F.lit(1)).alias("_n")).select(*by, PIECE, F.coalesce(before, F.lit(0)).alias("_base"))
    return own.join(bases, [*by, PIECE]).withColumn(name, F.col(name) + F.col("_base")).select(*rows.columns, name)


def placed(points: DataFrame, rows: DataFrame, by: list[str], order: str, at: str) -> DataFrame:
    """``points`` with the piece of ``rows`` that a row at their place ``at`` would be in; for a few points a key."""
    starts = rows.groupBy(*by, PIECE).agg(F.min(order).alias("_from")).withColumnRenamed(PIECE, "_of")
    joined = points.join(starts, by, "left") if by else points.crossJoin(starts)  # one row a piece
    return joined.groupBy(*points.columns).agg(F.coalesce(F.max(F.when(F.col("_from") <= F.col(at), F.col("_of"))), F.min("_of"), F.lit(0)).alias(PIECE))
