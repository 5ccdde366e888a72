"""Accuracy accounts with null-safe ratios, thresholds by grid search, and comparisons of expected and actual cells.

Rows are (value, prediction, score, margin, ...): value null is a control, which must not be accepted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES, MARGINS = 51, 31
#: Labels of the slices that are always reported.
FAMILIES = ("level", "bond", "tier", "skill")


def accepted(score: Column | float, margin: Column | float) -> Column:
    return F.col("prediction").isNotNull() & (F.col("score") >= score) & (F.col("margin") >= margin)


def measures(score: Column | float, margin: Column | float) -> list[Column]:
    """Twelve measures as aggregates; ratios of nothing are null."""
    numeric, right = F.col("value").isNotNull(), F.col("prediction") == F.col("value").cast("string")
    ok = F.coalesce(accepted(score, margin), F.lit(False))
    right = F.coalesce(right, F.lit(False))
    n, correct, taken, top = F.count_if(numeric), F.count_if(numeric & ok & right), F.count_if(numeric & ok), F.count_if(numeric & right)
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return [
        n.alias("numeric_n"),
        correct.alias("correct"),
        (taken - correct).alias("wrong"),
        (n - taken).alias("abstained"),
        top.alias("top1_correct"),
        ratio(correct, n).alias("correct_rate"),
        ratio(taken - correct, n).alias("wrong_rate"),
        ratio(taken, n).alias("coverage"),
        ratio(correct, taken).alias("accepted_accuracy"),
        ratio(top, n).alias("top1_accuracy"),
        F.count_if(~numeric).alias("control_n"),
        F.count_if(~numeric & ok).alias("control_false_accepts"),
    ]


def metrics(rows: DataFrame, score: float, margin: float, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*by).agg(*measures(score, margin)) if by else rows.agg(*measures(score, margin))


def grid_counts(rows: DataFrame) -> DataFrame:
    """(score, margin, correct, mistakes) at each point of the grid.

    A row counts at every point that isn't above it, so rows are first counted by the cell they fall in (at most 51 x 31), and
    the grid sums up cells; work beyond one pass doesn't grow with the rows."""
    spark = rows.sparkSession
    numeric = F.col("value").isNotNull()
    right = numeric & F.coalesce(F.col("prediction") == F.col("value").cast("string"), F.lit(False))
    # the largest grid number not above the value; compared as k / 100 on both sides
    def cell(x: str, low: int, high: int) -> Column:
        guess = F.floor(F.col(x) * 100).cast("int")
        exact = F.when((guess + 1) / 100.0 <= F.col(x), guess + 1).when(guess / 100.0 > F.col(x), guess - 1).otherwise(guess)
        return F.least(exact, F.lit(high))

    cells = (
        rows.where(F.col("prediction").isNotNull() & (F.col("score") >= 0.5) & (F.col("margin") >= 0))
        .groupBy(cell("score", 50, 100).alias("s"), cell("margin", 0, 30).alias("m"))
        .agg(F.count_if(right).alias("right"), F.count_if(~right).alias("wrong"))
    )
    points = spark.range(SCORES).select((F.col("id") + 50).cast("int").alias("ps")).crossJoin(spark.range(MARGINS).select(F.col("id").cast("int").alias("pm")))
    joined = points.join(F.broadcast(cells), (F.col("s") >= F.col("ps")) & (F.col("m") >= F.col("pm")), "left")  # at most 1,581 cells
    return joined.groupBy("ps", "pm").agg(F.coalesce(F.sum("right"), F.lit(0)).alias("correct"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("mistakes")).select((F.col("ps") / 100.0).alias("score"), (F.col("pm") / 100.0).alias("margin"), "correct", "mistakes")


def calibrate(rows: DataFrame, cap: float = 0.01) -> DataFrame:
    """One row (score, margin, correct, mistakes): the point with the most correct rows and then the fewest mistakes among those
    of at most ``cap`` mistakes; (1.01, 1) if no point gets anything right."""
    grid = grid_counts(rows).where(F.col("mistakes") <= cap * (F.col("correct") + F.col("mistakes")))
    default = rows.sparkSession.createDataFrame([(1.01, 1.0, 0, 0)], "score double, margin double, correct long, mistakes long")
    best = grid.unionByName(default).agg(F.max(F.struct("correct", (-F.col("mistakes")).alias("less"), "score", "margin")).alias("b"))
    return best.select("b.score", "b.margin", "b.correct", (-F.col("b.less")).alias("mistakes"))


def summarized(rows: DataFrame, score: float, margin: float, slices: dict[str, tuple[str, ...]]) -> DataFrame:
    """(slice, value, *measures): for each column in ``slices`` every listed value, also those without rows.  One pass."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([("all", "all"), *((c, v) for c, values in slices.items() for v in values)], "slice string, label string")
    tags = F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("label")), *(F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("label")) for c in slices))
    found = rows.withColumn("tag", F.explode(tags)).groupBy("tag.slice", "tag.label").agg(*measures(score, margin))
    counts = [c for c in found.columns if c not in ("slice", "label") and not c.endswith(("rate", "coverage", "accuracy"))]
    return listed.join(found, ["slice", "label"], "left").fillna(0, counts)


def compared_cells(expected: DataFrame, actual: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """(*on, state, *differences): matched, missing or extra cells, and for each value whether it agrees."""
    e, a = expected.withColumn("_e", F.lit(True)), actual.withColumnsRenamed({v: f"actual_{v}" for v in values}).withColumn("_a", F.lit(True))
    joined = e.join(a, on, "full")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("matched")
    return joined.select(*on, state.alias("state"), *(F.when(state == "matched", F.col(v).eqNullSafe(F.col(f"actual_{v}"))).alias(f"{v}_agrees") for v in values))


def validation_report(cells: DataFrame, value: str) -> DataFrame:
    """One row: cells by state, and of those detected how many values are right, wrong or withheld."""
    ok = F.col(f"{value}_agrees")
    return cells.agg(F.count_if(F.col("state") == "matched").alias("detected"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "extra").alias("extra"), F.count_if(ok).alias("correct"), F.count_if(~ok).alias("wrong"))


def leaks(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys in both splits; must be empty."""
    return a.select(*on).intersect(b.select(*on))


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, with the side; empty if both are the same bag."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def with_conditions(rows: DataFrame, conditions: DataFrame, limited_split: str, limited_to: tuple[str, ...]) -> DataFrame:
    """Each row under each condition; one split only under some.  ``conditions`` is a short list."""
    joined = rows.crossJoin(conditions)
    return joined.where((F.col("split") != limited_split) | F.col("condition").isin(*limited_to))


def top_k_accuracy(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: share of rows whose true label is among the first k of ``ranked`` (an array)."""
    hit = lambda k: F.avg(F.array_contains(F.slice("ranked", 1, k), F.col("label")).cast("double")).alias(f"top{k}")
    return rows.agg(*map(hit, ks))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def errors(difference: str) -> list[Column]:
    d = F.col(difference)
    return [F.avg(F.abs(d)).alias("mean_error"), F.max(F.abs(d)).alias("max_error"), F.sqrt(F.avg(d * d)).alias("rms_error")]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
