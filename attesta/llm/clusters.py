"""Centroid clustering by plain Lloyd rounds over integer vectors.

A vector is kept if it has exactly ``SIZE`` components, none of them null or non-finite; each component x becomes floor(256 * x),
held within +-2**27 so that every squared distance fits 64 bits.  The first centroids are the kept vectors whose seeded hash of
vec_id is smallest.  In a round the centroids (at most ``COUNT`` rows of ``SIZE`` integers, whatever the table) go to every task;
``mapInPandas`` takes the squared differences to each centroid in NumPy, the lowest index wins a tie, and a task gives one row
of sums per centroid that it met.  ``groupBy`` merges those, so no vector is shuffled; the driver divides ``COUNT`` sums.

The integer vectors are written once to the shared folder; every round reads that table, and a lost task is simply run again.

Defined results: rows with equal vec_id are vectors of their own (as starting centroids in order of their components); a null
vec_id is hashed as ``null``; fewer kept vectors than ``COUNT`` give as many centroids as there are vectors; equal
centroids leave the later ones empty, and an empty centroid stays; an empty table, or one without a kept vector, gives no rows; a
sum of distances beyond 64 bits is held at the largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import importable
from attesta.scratch import written

#: Components of a vector, centroids, rounds, and what stands before vec_id in the hash that chooses the first centroids.
SIZE, COUNT, ROUNDS, SEED = 64, 40, 5, "2"
#: A component is that many times its value, and at most that large.
SCALE, LARGEST = 256, 1 << 27
#: Vectors of a kernel's call: its differences stay in a processor's cache.
_ROWS = 1024
#: With differences up to here a sum of ``SIZE`` squares fits 32 bits.
_SMALL = 1 << 12


def whole_numbers(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, v): the kept vectors, as integers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # NaN isn't below infinity: Spark takes it as larger
    held = lambda c: F.floor(F.greatest(F.least(SCALE * c.cast("double"), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    return vectors.where((F.size(x) == size) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, held).alias("v"))


def first_centroids(kept: DataFrame, count: int = COUNT, seed: str = SEED) -> np.ndarray:
    """The ``count`` vectors with the smallest hash, in its order; each task gives no more than these."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = kept.select(order.alias("h"), "v").orderBy("h", "v").limit(count).collect()
    return np.array([r.v for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each vector's nearest centroid; the lowest index of equals."""
    cluster, distance = np.zeros(len(v), np.int32), np.zeros(len(v), np.int64)
    for a in range(0, len(v), _ROWS):
        part = v[a : a + _ROWS]
        low, high = min(part.min(), centroids.min()), max(part.max(), centroids.max())
        kind = np.int32 if high - low < _SMALL else np.int64
        part, own = part.astype(kind), centroids.astype(kind)
        squares = np.empty((len(centroids), len(part)), np.int64)
        for k, c in enumerate(own):
            gap = part - c
            squares[k] = np.einsum("ij,ij->i", gap, gap)
        cluster[a : a + _ROWS] = squares.argmin(0)
        distance[a : a + _ROWS] = squares.min(0)
    return cluster, distance


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0), np.int32)


def sums(kept: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(centroid, its vectors, their componentwise sums), of those that are nearest to some vector."""
    count, size = centroids.shape
    held = kept.sparkSession.sparkContext.broadcast(centroids)  # count * size integers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(count, np.int64), np.zeros((count, size), np.int64)
        for batch in batches:
            if len(batch):
                v = _stacked(batch["v"])
                cluster, _ = nearest(v, held.value)
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                total[found] += np.add.reduceat(v[order].astype(np.int64), first, axis=0)
                n += np.bincount(cluster, minlength=count)
        met = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": met.astype(np.int32), "n": n[met], **{f"s{i}": total[met, i] for i in range(size)}})

    schema = "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(size))
    merged = kept.select("v").mapInPandas(run, schema).groupBy("cluster").agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(size)])
    return sorted((r[0], r[1], list(r[2:])) for r in merged.collect())  # one row a centroid


def lloyd(kept: DataFrame, *, count: int = COUNT, rounds: int = ROUNDS, seed: str = SEED) -> np.ndarray:
    """The centroids after all rounds."""
    centroids = first_centroids(kept, count, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for k, n, total in sums(kept, centroids):
            centroids[k] = [t // n for t in total]
    return centroids


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    held = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cluster, distance = nearest(_stacked(batch["v"]), held.value)
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "cluster": cluster, "distance": distance})

    return kept.mapInPandas(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, *, size: int = SIZE, count: int = COUNT, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = vectors.sparkSession
    kept = written(whole_numbers(vectors, size), "vectors")
    centroids = lloyd(kept, count=count, rounds=rounds, seed=seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    table = assigned(kept, centroids)
    of = {r[0]: int(r[1]) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    top = (1 << 63) - 1
    rows = [(k, min(top, n), min(top, sum(of.values())), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, n in sorted(of.items())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a centroid


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters after five rounds."""
    importable(spark)
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(size: int = SIZE, count: int = COUNT, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same as SQL for DuckDB: a table of centroids and one of assignments for each round."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, list_transform(embedding, lambda x: CAST(floor(greatest(least({SCALE} * CAST(x AS DOUBLE), {LARGEST}), -{LARGEST})) AS BIGINT)) AS v
FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {size})""",
        "r AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, v FROM v)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT h, v FROM v ORDER BY h, v LIMIT {count}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best
FROM (SELECT row, vec_id, r.v, c, CAST(list_sum(list_transform(list_zip(r.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM r, c{i} k) GROUP BY row)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v
FROM (SELECT best.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, {size + 1}) AS t(j) GROUP BY best.c, j) GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} k ON k.c = best.c"""
