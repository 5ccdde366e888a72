"""Time-ordered series: motion, stable segments, samples, resampling and look-ups.

A series is (*by, idx, ...).  Windows run within ``by``.  A series without a key, or with keys that hold a large part of it, is dealt by
``scans.by_ranges`` first: what has its pieces is scanned piece by piece, and its pieces go along with the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from attesta.functions.numbers import mean_absolute_difference
from attesta.operators import scans
from attesta.operators.selection import MOST, medians
from attesta.scratch import written

QUANTILES = (0.2, 0.5, 0.8)


def _over(by: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def motion(series: DataFrame, by: list[str] | None = None, signature: str = "signature") -> DataFrame:
    """(*by, idx, motion): mean absolute difference to the previous signature; 0 for the first.  A scalar is a signature too."""
    moved = scans.beside(series, by or [], ["idx"], F.col(signature), "_before")
    now, before = F.col(signature), F.col("_before")
    vector = dict(series.dtypes)[signature].startswith("array")
    change = mean_absolute_difference(now, before) if vector else F.abs(now - before)
    return moved.select(*(by or []), "idx", F.coalesce(change, F.lit(0.0)).alias("motion"), *scans.pieced(series))


def threshold(moved: DataFrame, by: list[str] | None = None, most: int = MOST) -> DataFrame:
    """(*by, median, mad, threshold, n): median plus eight deviations of at least 0.05, within 1.5..5, over all values.  Both medians are
    exact; groups of more than ``most`` values are narrowed down, not gathered."""
    by = by or []
    centre = written(medians(moved, by, "motion", most), "medians")
    joined = moved.join(centre, by) if by else moved.crossJoin(centre)  # one row
    spread = medians(joined.select(*by, F.abs(F.col("motion") - F.col("median")).alias("_d")), by, "_d", most).select(*by, F.col("median").alias("mad"))
    found = centre.join(spread, by) if by else centre.crossJoin(spread)  # one row each
    limit = F.greatest(F.lit(1.5), F.least(F.lit(5.0), F.col("median") + 8 * F.greatest(F.col("mad"), F.lit(0.05))))
    return written(found.select(*by, "median", "n", "mad", limit.alias("threshold")), "limits")  # one row a key, which all that follows reads


def islands(moved: DataFrame, limits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, start, cut): runs of neighbouring changed samples; a cut is the last of a run."""
    by = by or []
    joined = moved.join(limits, by) if by else moved.crossJoin(limits)  # one row
    changed = scans.beside(joined.where("motion > threshold").select(*by, "idx", *scans.pieced(moved)), by, ["idx"], F.col("idx"), "_before")
    begins = F.when(F.col("_before").isNull() | (F.col("_before") < F.col("idx") - 1), F.col("idx"))
    runs = scans.last_known(changed, by, ["idx"], begins, "start")
    return runs.groupBy(*by, "start").agg(F.max("idx").alias("cut"), *(F.max(c).alias(c) for c in scans.pieced(moved)))


def intervals(found: DataFrame, limits: DataFrame, by: list[str] | None = None, moved: DataFrame | None = None) -> DataFrame:
    """(*by, left, right): what lies between the distinct cuts, with 0 and the end.  Of a series in pieces ``moved`` tells theirs."""
    by = by or []
    ends = limits.select(*by, F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("cut"))
    if scans.pieced(found):
        ends = scans.placed(ends, moved, by, "idx", "cut")
    cuts = found.select(*by, F.col("cut").cast("long").alias("cut"), *scans.pieced(found)).unionByName(ends)
    cuts = cuts.groupBy(*by, "cut").agg(*(F.max(c).alias(c) for c in scans.pieced(found))) if scans.pieced(found) else cuts.distinct()
    return scans.beside(cuts, by, ["cut"], F.col("cut"), "right", ahead=True).where("right is not null").select(*by, F.col("cut").alias("left"), "right", *scans.pieced(found))


def stable(moved: DataFrame, limits: DataFrame, spans: DataFrame, by: list[str] | None = None, share: float = 0.35) -> DataFrame:
    """(*by, left, right, idx): samples inside an interval that neither they nor the next one move."""
    by = by or []
    ahead = scans.beside(moved, by, ["idx"], F.col("motion"), "next_motion", ahead=True)
    joined = ahead.join(limits, by) if by else ahead.crossJoin(limits)  # one row
    still = joined.where((F.col("motion") < share * F.col("threshold")) & (F.col("next_motion") < share * F.col("threshold"))).select(*by, "idx", *scans.pieced(moved))
    # intervals follow one another, so a sample's is the last that starts at or before it: one sort of both sides together
    starts = spans.select(*by, F.col("left").cast("long").alias("idx"), F.struct("left", "right").alias("_i"), F.lit(0).alias("_tag"), *scans.pieced(moved))
    both = starts.unionByName(still.select(*by, F.col("idx").cast("long").alias("idx"), F.lit(1).alias("_tag"), *scans.pieced(moved)), allowMissingColumns=True)
    held = scans.last_known(both, by, ["idx", "_tag"], F.col("_i"), "_own").where("_tag = 1").select(*by, "_own.left", "_own.right", "idx", *scans.pieced(moved))
    return held.where((F.col("idx") > F.col("left")) & (F.col("idx") < F.col("right") - 1))


def samples(inside: DataFrame, by: list[str] | None = None, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(*by, left, right, idx): of each interval the distinct samples at the quantiles, with places rounded half to even."""
    group = [*(by or []), "left", "right"]
    counts = inside.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    joined = scans.numbered(inside, group, ["idx"], "at").join(counts, group)
    hit = F.lit(False)
    for q in quantiles:
        hit = hit | (F.col("at") == F.bround(q * (F.col("n") - 1)).cast("long"))
    return joined.where(hit).select(*group, "idx")


def segments(spans: DataFrame, chosen: DataFrame, by: list[str] | None = None, fps: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded): kept intervals get numbers from 1 in their order, and times; those without a stable sample go."""
    by = by or []
    counts = chosen.groupBy(*by, "left", "right").agg(F.count(F.lit(1)).alias("samples"))
    joined = spans.join(counts, [*by, "left", "right"], "left")
    kept = scans.numbered(joined.where("samples is not null"), by, ["left"], "segment").drop(scans.PIECE).withColumn("segment", F.col("segment") + 1)
    kept = kept.withColumns({"start_seconds": F.col("left") / fps, "end_seconds": F.col("right") / fps})
    return kept, joined.where("samples is null").select(*by, "left", "right", F.lit("no stable interior samples").alias("reason"))


def as_of(grid: DataFrame, frames: DataFrame, by: list[str] | None = None, time: str = "ts", value: str = "frame", tolerance: float = 1e-8) -> DataFrame:
    """(*by, grid time, value): for each grid time the last frame at or before it.  One sort of both sides together, no range join."""
    by = by or []
    left = frames.select(*by, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_tag"), F.col(value).alias("_v"), F.lit(None).cast("double").alias(time))
    right = grid.select(*by, (F.col(time) + tolerance).cast("double").alias("_t"), F.lit(1).alias("_tag"), F.lit(None).cast(dict(frames.dtypes)[value]).alias("_v"), F.col(time).cast("double").alias(time))
    w = _over(by, "_t", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    return left.union(right).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_tag = 1").select(*by, time, value)


#: Levels of nodes over buckets: enough for all 64-bit numbers of buckets.
LEVELS = 62


def nodes(start: Column, end: Column) -> Column:
    """The fewest nodes that cover the buckets start..end (both included), two of a level at most: array of (level, place); a node at a
    level covers ``2**level`` buckets.  Walking up, an end that is the odd one of its pair leaves a node and steps inwards."""
    seed = F.struct(start.alias("a"), end.alias("b"), F.array().cast("array<struct<level:int,place:bigint>>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        node = lambda place: F.array(F.struct(level.cast("int").alias("level"), place.alias("place")))
        none = F.array().cast("array<struct<level:int,place:bigint>>")
        odd, even = (a <= b) & (F.pmod(a, F.lit(2)) == 1), (a <= b) & (F.pmod(b, F.lit(2)) == 0)
        left, right = F.when(odd, node(a)).otherwise(none), F.when(even & ~(odd & (a == b)), node(b)).otherwise(none)
        a, b = F.when(odd, a + 1).otherwise(a), F.when(even, b - 1).otherwise(b)
        done = a > b  # and stays so
        return F.struct(F.when(done, a).otherwise(F.shiftright(a, 1)).alias("a"), F.when(done, b).otherwise(F.shiftright(b, 1)).alias("b"), F.concat(acc["out"], left, right).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), seed, step, lambda acc: acc["out"])


def in_interval(points: DataFrame, spans: DataFrame, time: Column, start: Column, end: Column, width: float) -> DataFrame:
    """``points`` joined to the intervals [start, end) that hold them.  An interval of any length is a few nodes, two of each level at
    most over buckets of ``width``; a point is looked up in the nodes above its bucket, at the levels that some interval uses, by an equal
    join, and the exact test follows.  An empty interval holds nothing."""
    some = spans.where(start < end)
    covered = some.withColumn("_node", F.explode(nodes(F.floor(start / width), F.floor(end / width))))
    used = covered.agg(F.array_sort(F.collect_set("_node.level")).alias("l")).first()["l"] or [0]  # at most LEVELS + 1
    bucket = F.floor(time / width)
    place = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(bucket, k).alias("place")) for k in used))
    return points.withColumn("_node", F.explode(place)).join(covered, "_node").where((time >= start) & (time < end)).drop("_node")


def neighbours(rows: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Each row with the keys before and after it."""
    w = _over(by, order)
    return rows.withColumns({"previous": F.lag(key).over(w), "next": F.lead(key).over(w)})


def nearest(points: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """(*by, t, mark): for each point the mark of least distance, the earlier of equals; two passes of as-of, one from each end, no
    pairs.  Both frames begin at an end, so each row adds to what the one before it has."""
    tagged = points.select(*by, "t", F.lit(None).cast("double").alias("m")).union(marks.select(*by, F.col("mark").alias("t"), F.col("mark").cast("double").alias("m")))
    w = Window.partitionBy(*by).orderBy("t")
    before = F.last("m", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.last("m", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))
    found = tagged.withColumns({"_a": before, "_b": after}).where("m is null")
    later = F.col("_a").isNull() | (F.col("_b") - F.col("t") < F.col("t") - F.col("_a"))
    return found.select(*by, "t", F.when(later, F.col("_b")).otherwise(F.col("_a")).alias("mark"))


def last_by_order(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The value that comes last, by key."""
    return rows.groupBy(*by).agg(F.max_by(value, order).alias(value))


def bootstrapped(rows: DataFrame, by: list[str], order: str, accepted: Column) -> DataFrame:
    """``rows`` with the reference that each is matched against and how: the first accepted row of a series builds it, those before
    it have none, and all later ones use it."""
    first = F.min(F.when(accepted, F.col(order))).over(_over(by, order).rowsBetween(Window.unboundedPreceding, 0))
    method = F.when(first.isNull(), "unmatched").when(first == F.col(order), "built").otherwise("reference")
    return rows.withColumns({"reference": first, "method": method})


def early_stop(history: DataFrame, by: list[str], patience: int, metric: str = "metric", step: str = "epoch") -> DataFrame:
    """Each step with the best metric before it, whether it improves strictly, how many steps in a row did not, and whether to stop."""
    w = _over(by, step)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(metric) > before)
    marked = history.withColumn("improved", better)
    group = F.sum(F.col("improved").cast("int")).over(w)
    marked = marked.withColumn("_g", group)
    streak = F.row_number().over(_over([*by, "_g"], step)) - 1
    return marked.withColumn("stale", streak).withColumn("stop", F.col("stale") >= patience).drop("_g")
