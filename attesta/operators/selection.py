"""Exact medians of groups of any size, by narrowing.

A group of more than ``MOST`` values isn't gathered.  A round takes approximate quantiles of the values that are still in
question (a mergeable sketch of bounded size), picks two of them, with a margin beyond the sketch's error, around the middle
ranks, and counts exactly what lies below, at, between and beyond them.  If a middle rank falls on one of the two values it is
found; otherwise only what lies between stays in question, a few thousandths of it.  Once few different values are left, those
are counted one by one.  Ties are counted, never listed, so a group of equal values takes one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.scans import plain_unions
from attesta.scratch import written

#: Different values of a group that may be listed.
MOST = 100_000
#: Quantiles that a round takes, and the accuracy of the sketch, whose error is far below the distance of two of them.
STEPS, ACCURACY = 1024, 16_384


def _joined(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(state, by) if by else rows.crossJoin(state)  # one row


def medians(rows: DataFrame, by: list[str], value: str, most: int = MOST) -> DataFrame:
    """(*by, median, n): the median of the values that aren't null, halfway between the middle two of an even number, and the number of
    rows."""
    plain_unions(rows.sparkSession)
    v = F.col(value).cast("double")
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("_n"))
    counted = written(counted, "counts")
    small = _joined(rows, counted.where(F.col("_n") <= most), by).groupBy(*by, "n").agg(F.median(v).alias("median")).select(*by, "median", "n")
    large = counted.where(F.col("_n") > most)
    if large.isEmpty():
        return small
    values = rows.where(v.isNotNull()).select(*by, v.alias("_v"))
    ranks = (F.floor((F.col("_n") - 1) / 2).alias("_r1"), F.floor(F.col("_n") / 2).alias("_r2"))
    nothing = F.lit(None).cast("double")
    # in question: values inside (_lo, _hi), ``_inside`` of them; ``_below`` values lie before
    state = large.select(*by, "n", *ranks, F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"), nothing.alias("_lo"), nothing.alias("_hi"))
    done = small
    for _ in range(64):
        found = written(_narrowed(values, state, by), "narrowed")
        known = found.where("_v1 is not null and _v2 is not null")
        done = done.unionByName(known.select(*by, _halfway(F.col("_v1"), F.col("_v2")).alias("median"), "n"))
        left = found.where("_v1 is null or _v2 is null")
        listed = left.where(F.col("_kinds") <= most)
        done = done.unionByName(_listed(values, listed, by))
        state = left.where(F.col("_kinds") > most).select(*by, "n", "_r1", "_r2", "_below", "_inside", "_lo", "_hi")
        if state.isEmpty():
            return done
    raise RuntimeError("the values in question do not become fewer")


def _halfway(a: Column, b: Column) -> Column:
    return F.when(a == b, a).otherwise((a + b) / 2)


def _questioned(values: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_v")
    return _joined(values, state, by).where((lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi)))


def _narrowed(values: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """The state with closer bounds, what is known of the middle values (_v1, _v2), and about how many kinds of values are in question."""
    keys = [*by, "n", "_r1", "_r2", "_below", "_inside"]
    marks = _questioned(values, state, by).groupBy(*keys).agg(F.percentile_approx("_v", [i / STEPS for i in range(STEPS + 1)], ACCURACY).alias("_q"))
    place = lambda r, up: (F.col(r) - F.col("_below") + up) / F.col("_inside") * STEPS
    first = F.greatest(F.lit(0), F.floor(place("_r1", 0)) - 1).cast("int")
    last = F.least(F.lit(STEPS), F.ceil(place("_r2", 1)) + 1).cast("int")
    marks = marks.select(*keys, F.get("_q", first).alias("_a"), F.get("_q", last).alias("_b"))
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    between = (v > a) & (v < b)
    number = lambda c: F.sum(F.when(c, 1).otherwise(0))
    asked = _joined(values, marks.join(state.select(*by, "_lo", "_hi"), by) if by else marks.crossJoin(state.select("_lo", "_hi")), by)  # one row
    asked = asked.where((F.col("_lo").isNull() | (v > F.col("_lo"))) & (F.col("_hi").isNull() | (v < F.col("_hi"))))
    counts = asked.groupBy(*keys, "_a", "_b").agg(
        number(v < a).alias("_before"),
        number(v == a).alias("_at_a"),
        number(between).alias("_between"),
        number((v == b) & (b > a)).alias("_at_b"),
        F.min(F.when(v > a, v)).alias("_after_a"),
        F.max(F.when(v < b, v)).alias("_before_b"),
        F.approx_count_distinct(F.when(between, v)).alias("_kinds"),
    )
    to_a = F.col("_below") + F.col("_before")
    to_between, to_b = to_a + F.col("_at_a"), to_a + F.col("_at_a") + F.col("_between")

    def at(r: str) -> Column:
        return F.when((F.col(r) >= to_a) & (F.col(r) < to_between), a).when((F.col(r) >= to_b) & (F.col(r) < to_b + F.col("_at_b")), b)

    one, two = at("_r1"), at("_r2")
    # neighbouring ranks of which one is known: the other is the next value
    one = F.when(one.isNull() & (F.col("_r2") == to_b), F.col("_before_b")).otherwise(one)
    two = F.when(two.isNull() & (F.col("_r1") == to_between - 1), F.col("_after_a")).otherwise(two)
    return counts.select(*by, "n", "_r1", "_r2", to_between.alias("_below"), F.col("_between").alias("_inside"), a.alias("_lo"), b.alias("_hi"), one.alias("_v1"), two.alias("_v2"), "_kinds")


def _listed(values: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """(*by, median, n) where few kinds of values are in question: each is counted, and the middle ranks are looked up."""
    kinds = _questioned(values, state, by).groupBy(*by, "n", "_r1", "_r2", "_below", "_v").agg(F.count(F.lit(1)).alias("_times"))
    upto = F.col("_below") + F.sum("_times").over(Window.partitionBy(*by).orderBy("_v"))  # at most some 100,000 rows a key
    placed = kinds.withColumn("_to", upto)
    first = lambda r: F.min(F.when(F.col("_to") > F.col(r), F.col("_v")))
    return placed.groupBy(*by, "n").agg(_halfway(first("_r1"), first("_r2")).alias("median")).select(*by, "median", "n")
