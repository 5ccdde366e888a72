"""Rectangles and positions: clustering along a line, overlap suppression and grids.

These walk in order through the few dozen rectangles of one image, so an image is a group; the walks are folds over a sorted
array (clusters) or one pandas group a image (suppression)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue in half degrees, saturation and value of blue, green, red bytes."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    top = image.max(-1).astype(float)
    spread = top - image.min(-1)
    some = np.maximum(spread, 1)
    hue = np.select([spread == 0, top == r, top == g], [0.0, (g - b) / some * 60, 120 + (b - r) / some * 60], 240 + (r - g) / some * 60)
    return np.stack([np.rint(np.where(hue < 0, hue + 360, hue) / 2) % 180, np.rint(np.divide(255 * spread, np.maximum(top, 1))), top], -1)


def within(image: np.ndarray, bounds: tuple[tuple[int, ...], tuple[int, ...]]) -> np.ndarray:
    x = hsv(image)
    return ((x >= bounds[0]) & (x <= bounds[1])).all(-1)


def _median(x: Column) -> Column:
    s = F.array_sort(x)
    n = F.size(s)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def line_groups(values: Column, tolerance: Column) -> Column:
    """Medians of clusters along a line: a value joins the open cluster unless it lies beyond its median by ``tolerance``."""
    empty = F.array().cast("array<array<double>>")

    def step(groups: Column, x: Column) -> Column:
        last = F.get(groups, F.size(groups) - 1)
        opens = (F.size(groups) == 0) | (x - _median(last) > tolerance)
        rest = F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0)))
        return F.when(opens, F.concat(groups, F.array(F.array(x)))).otherwise(F.concat(rest, F.array(F.concat(last, F.array(x)))))

    folded = F.aggregate(F.array_sort(F.transform(values, lambda v: v.cast("double"))), empty, step)
    return F.transform(folded, _median)


def suppressed(boxes: DataFrame, share: float = 0.8) -> DataFrame:
    """(image_id, x, y, width, height): largest first, a box goes if a kept one covers more than ``share`` of it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[float, float, float, float]] = []
        for x, y, w, h in sorted(group[["x", "y", "width", "height"]].itertuples(index=False, name=None), key=lambda b: (-b[2] * b[3], b)):
            covered = (max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b)) for a, b, c, d in kept)
            if not any(o > share * w * h for o in covered):
                kept.append((x, y, w, h))
        out = pd.DataFrame(kept, columns=["x", "y", "width", "height"])
        out.insert(0, "image_id", group["image_id"].iloc[0])
        return out

    return boxes.groupBy("image_id").applyInPandas(run, "image_id long, x double, y double, width double, height double")


def card_sizes(boxes: DataFrame, within: float = 0.16) -> DataFrame:
    """(image_id, width, height, members): the repeated geometry, the cluster of similar boxes with the most of count times
    median area.  Boxes of one image only are compared."""
    a, b = boxes.alias("a"), boxes.alias("b")
    near = (F.abs(F.col("b.width") / F.col("a.width") - 1) < within) & (F.abs(F.col("b.height") / F.col("a.height") - 1) < within)
    pairs = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & near)
    seeds = pairs.groupBy(*(F.col(f"a.{c}").alias(c) for c in ("image_id", "x", "y", "width", "height"))).agg(F.count(F.lit(1)).alias("members"), F.median(F.col("b.width") * F.col("b.height")).alias("area"), F.median("b.width").alias("w"), F.median("b.height").alias("h"))
    best = F.max_by(F.struct("w", "h", "members"), F.struct(F.col("members") * F.col("area"), -F.col("x"), -F.col("y")))
    return seeds.groupBy("image_id").agg(best.alias("s")).select("image_id", F.col("s.w").alias("width"), F.col("s.h").alias("height"), F.col("s.members").alias("members"))


def grid_cells(boxes: DataFrame, sizes: DataFrame, share: float = 0.25) -> DataFrame:
    """(image_id, row, col, x, y): crossings of the lines along which the boxes of an image stand."""
    both = boxes.join(sizes.select("image_id", F.col("width").alias("w"), F.col("height").alias("h")), "image_id")
    lines = both.groupBy("image_id").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"), F.first("w").alias("w"), F.first("h").alias("h"))
    lines = lines.select("image_id", line_groups(F.col("xs"), share * F.col("w")).alias("xs"), line_groups(F.col("ys"), share * F.col("h")).alias("ys"))
    rows = lines.select("image_id", "xs", F.posexplode("ys").alias("row", "y"))
    return rows.select("image_id", "row", F.posexplode("xs").alias("col", "x"), "y").select("image_id", "row", "col", "x", "y")


def frame_signatures(frames: DataFrame, blocks: tuple[int, int] = (24, 100)) -> DataFrame:
    """(idx, signature) of grey frames (idx, width, height, pixels as bytes): means of blocks, the series that ``timeline`` takes."""
    import pyarrow as pa

    down, across = blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, data in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "pixels")), strict=True):
                image = np.frombuffer(data, np.uint8).reshape(h, w).astype(np.float32)
                ys, xs = np.linspace(0, h, down + 1).astype(int), np.linspace(0, w, across + 1).astype(int)
                sums = np.add.reduceat(np.add.reduceat(image, np.minimum(ys[:-1], h - 1), 0), np.minimum(xs[:-1], w - 1), 1)
                area = np.maximum(1, np.diff(ys))[:, None] * np.maximum(1, np.diff(xs))[None, :]
                out.append((sums / area).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(out, pa.list_(pa.float32()))], ["idx", "signature"])

    return frames.select(F.col("idx").cast("long").alias("idx"), "width", "height", "pixels").mapInArrow(run, "idx long, signature array<float>")


def grey_measures(frames: DataFrame, dark: int = 130, percents: tuple[int, ...] = (95, 99)) -> DataFrame:
    """(idx, dark, p95, p99) of grey frames (idx, pixels as bytes): the share of pixels below ``dark``, and exact percentiles."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [np.frombuffer(x, np.uint8) for x in batch.column("pixels").to_pylist()]
            shares = pa.array([float((x < dark).mean()) if len(x) else None for x in images], pa.float64())
            cuts = [pa.array([float(np.percentile(x, p)) if len(x) else None for x in images], pa.float64()) for p in percents]
            yield pa.RecordBatch.from_arrays([batch.column("idx"), shares, *cuts], ["idx", "dark", *(f"p{p}" for p in percents)])

    return frames.select(F.col("idx").cast("long").alias("idx"), "pixels").mapInArrow(run, "idx long, dark double" + "".join(f", p{p} double" for p in percents))


def colour_shares(frames: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], region: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> DataFrame:
    """(idx, share) of frames (idx, width, height, pixels as blue, green, red bytes): the share of a region's pixels (left, top,
    right, bottom in shares of the frame) whose hue (half degrees), saturation and value lie within bounds."""
    import pyarrow as pa


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, upper, right, lower = region
        for batch in batches:
            out = []
            for w, h, data in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "pixels")), strict=True):
                image = np.frombuffer(data, np.uint8).reshape(h, w, 3)[int(h * upper) : int(h * lower), int(w * left) : int(w * right)]
                out.append(float(within(image, (low, high)).mean()) if image.size else None)
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(out, pa.float64())], ["idx", "share"])

    return frames.select(F.col("idx").cast("long").alias("idx"), "width", "height", "pixels").mapInArrow(run, "idx long, share double")


#: Changes that a reader must bear: brightness, a shift to the right and down, and a detour over another size.
PERTURBATIONS = {"clean": (1.0, 0, 0, 1.0), "dark": (0.75, 0, 0, 1.0), "bright": (1.25, 0, 0, 1.0), "shift": (1.0, 2, 1, 1.0), "half": (1.0, 0, 0, 0.5)}


def perturbed(frames: DataFrame, conditions: dict[str, tuple[float, int, int, float]] = PERTURBATIONS) -> DataFrame:
    """(idx, condition, width, height, pixels): grey frames (idx, width, height, pixels as bytes) under each condition.  Shifts
    repeat the edge; a detour takes the nearest pixels both ways."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, w, h, data in zip(*(batch.column(c).to_pylist() for c in ("idx", "width", "height", "pixels")), strict=True):
                image, out = np.frombuffer(data, np.uint8).reshape(h, w), []
                for light, right, down, size in conditions.values():
                    rows, columns = np.arange(h), np.arange(w)
                    if size != 1:
                        rows, columns = ((np.minimum((np.floor(np.floor(x * size) / size)).astype(int), n - 1)) for x, n in ((rows, h), (columns, w)))
                    moved = image[np.clip(rows - down, 0, h - 1)][:, np.clip(columns - right, 0, w - 1)]
                    out.append(np.clip(np.rint(moved * light), 0, 255).astype(np.uint8).tobytes())
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([idx] * n, pa.int64()), pa.array(list(conditions)), pa.array([w] * n, pa.int32()), pa.array([h] * n, pa.int32()), pa.array(out, pa.binary())], ["idx", "condition", "width", "height", "pixels"])

    return frames.select(F.col("idx").cast("long").alias("idx"), "width", "height", "pixels").mapInArrow(run, "idx long, condition string, width int, height int, pixels binary")
