"""Lloyd rounds against plain Python integers, and against the SQL."""

import hashlib
import math
import os
import random

import numpy as np
import pytest

from attesta.llm import clusters

DATA = "/root/testdata/sf0.001"


def brute(rows, size, count, rounds, seed="2"):
    kept = [(i, [max(-clusters.LARGEST, min(clusters.LARGEST, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds if kept else 0):
        found = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign() if kept else []
    inertia = [sum(d for d, c in found if c == k) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=lambda r: tuple((x is None, x) for x in r))


def got(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(7)
    rows = [(i, [r.gauss(r.choice([-1, 0, 1]), 0.2) for _ in range(4)]) for i in range(120)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[3][1]), (None, rows[3][1]), (300, None), (301, []), (302, [1.0] * 3), (303, [1.0, None, 0.0, 0.0]), (304, [1.0, float("nan"), 0.0, 0.0]), (305, [float("inf"), 0.0, 0.0, 0.0]), (306, [float("-inf"), 0.0, 0.0, 0.0]), (307, [0.0, -0.0, -1 / 512, 1 / 512])]
    rows += [(400 + i, rows[0][1]) for i in range(30)]  # copies
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int"), rows


@pytest.mark.parametrize(("count", "rounds"), [(7, 5), (40, 2), (500, 1), (1, 0)])
def test_rounds(odd, count, rounds):
    df, rows = odd
    assert got(clusters.clustered(df, size=4, count=count, rounds=rounds)) == brute(rows, 4, count, rounds)


def test_values_of_any_size(spark):
    rows = [(i, [float(v), 0.5]) for i, v in enumerate([1e38, -1e38, 3e5, 3e5 + 0.001, 1e300, 2.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(clusters.clustered(df, size=2, count=3, rounds=3)) == brute(rows, 2, 3, 3)
    floats = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, -0.7])], "vec_id long, embedding array<float>")
    assert got(clusters.clustered(floats, size=2)) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in ((1, [0.1, 0.2]), (2, [0.3, -0.7]))], 2, 40, 5)


def test_empty_tables(odd):
    df, _ = odd
    assert clusters.clustered(df.where("false"), size=4).count() == 0
    assert clusters.clustered(df, size=64).count() == 0


def test_nearest_takes_the_lowest_index():
    c = np.array([[5, 5], [0, 0], [0, 0], [10, 0]], np.int64)
    index, distance = clusters.nearest(np.array([[0, 1], [5, 0], [10, 10]], np.int32), c)
    assert index.tolist() == [1, 0, 0] and distance.tolist() == [1, 25, 50]
    wide = np.array([[clusters.LARGEST] * 64, [-clusters.LARGEST] * 64], np.int64)
    assert clusters.nearest(wide.astype(np.int32), wide[:1])[1].tolist() == [0, 64 * (2 * clusters.LARGEST) ** 2]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    assert got(clusters.op13_lloyd(spark, DATA)) == sorted(c.execute(clusters.sql()).fetchall())
