"""Arithmetic of the data model as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected_amount(low: Column, high: Column, amount: Column) -> Column:
    """The mean of a range, else the amount, else 1."""
    return F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(amount.isNotNull(), amount.cast("double")).otherwise(1.0)


def default_chance(chance: Column) -> Column:
    """Only an unknown chance counts as certain; 0 stays 0."""
    return F.coalesce(chance, F.lit(1.0))


def joint_chance(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), a * b)


def back_off(delay: Column, failures: Column, http_status: Column | None = None, retry_after: Column | None = None, most: float = 86400.0) -> Column:
    """Seconds to wait: doubling up to a day; a day for what is gone, at least Retry-After where a server asks for it."""
    wait = F.least(F.lit(most), delay * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(16))))
    if http_status is None:
        return wait
    asked = F.greatest(wait, F.coalesce(retry_after, F.lit(0.0))) if retry_after is not None else wait
    return F.when(http_status.isin(404, 410), F.lit(most)).when(http_status.isin(429, 503), asked).otherwise(wait)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds from a Retry-After header: a number, or a date relative to ``now`` (epoch seconds)."""
    date = F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0.0), F.coalesce(header.try_cast("double"), F.unix_timestamp(date) - now))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, not once for each entry that a lambda inside of ``use`` sees."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def softmax(logits: Column) -> Column:
    powers = once(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return once(powers, lambda p: once(total(p), lambda whole: F.transform(p, lambda x: x / whole)))


def argmax(x: Column) -> Column:
    """Place of the largest entry, the first of equals."""
    return F.array_position(x, F.array_max(x)) - 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def normalized_correlation(a: Column, b: Column) -> Column:
    """Cosine of what deviates from the means."""
    centred = lambda x: once(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean))
    return cosine(centred(a), centred(b))


def mean_absolute_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def affine(x: Column, y: Column, matrix: Column) -> Column:
    """struct(x, y) under a 2 x 3 matrix given as an array of six numbers."""
    m = [F.get(matrix, F.lit(i)) for i in range(6)]
    return F.struct((m[0] * x + m[1] * y + m[2]).alias("x"), (m[3] * x + m[4] * y + m[5]).alias("y"))


def envelope(points: Column) -> Column:
    """struct(left, top, right, bottom) of an array of struct(x, y)."""
    axis = lambda k: F.transform(points, lambda p: p[k])
    return F.struct(F.array_min(axis("x")).alias("left"), F.array_min(axis("y")).alias("top"), F.array_max(axis("x")).alias("right"), F.array_max(axis("y")).alias("bottom"))


def absolute_box(cell: Column, box: Column) -> Column:
    """A box given in shares of a cell, in whole pixels (half to even) of the image."""
    at = lambda o, size, part: F.bround(cell[o] + box[part] * cell[size]).cast("long")
    return F.struct(at("x", "width", "left").alias("left"), at("y", "height", "top").alias("top"), at("x", "width", "right").alias("right"), at("y", "height", "bottom").alias("bottom"))


def overlap(a: Column, b: Column) -> Column:
    """Area that two struct(x, y, width, height) share."""
    side = lambda o, s: F.greatest(F.lit(0), F.least(a[o] + a[s], b[o] + b[s]) - F.greatest(a[o], b[o]))
    return side("x", "width") * side("y", "height")


def weighted(parts: list[tuple[float, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in parts])


def iso_utc(seconds: Column) -> Column:
    """UTC date and time of positive epoch seconds, else null; the session's time zone must be UTC."""
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def warmup_cosine(step: Column, warmup: int, total: int, floor: float = 0.0) -> Column:
    """Share of the full rate at a step: a linear start, then half a cosine down to ``floor``."""
    progress = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, (step + 1) / max(1, warmup)).otherwise(floor + (1 - floor) * (1 + F.cos(F.lit(3.141592653589793) * F.least(progress, F.lit(1.0)))) / 2)
