"""Series dealt in pieces against plain Python over the whole series; exact medians against sorting."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from attesta.operators import scans, selection, timeline
from attesta.scratch import written

PIECES = (None, 1, 2, 50)  # None: plain windows
FEW = (None, 50)


def dealt(df, by, pieces):
    return df if pieces is None else scans.by_ranges(df, by, "idx", pieces)


def brute(signatures):
    """Motion, threshold, islands, intervals, chosen samples and segments of one series."""
    n = len(signatures)
    motion = [0.0] + [abs(b - a) for a, b in zip(signatures, signatures[1:], strict=False)]
    middle = median(motion)
    spread = median(abs(m - middle) for m in motion)
    limit = max(1.5, min(5.0, middle + 8 * max(spread, 0.05)))
    islands = []
    for i in range(n):
        if motion[i] > limit:
            if islands and islands[-1][1] == i - 1:
                islands[-1][1] = i
            else:
                islands.append([i, i])
    cuts = sorted({0, n, *(c for _, c in islands)})
    spans = list(zip(cuts, cuts[1:], strict=False))
    chosen, kept, gone = [], [], []
    for a, b in spans:
        still = [i for i in range(a + 1, b - 1) if motion[i] < 0.35 * limit and motion[i + 1] < 0.35 * limit]
        picks = sorted({still[round(q * (len(still) - 1))] for q in (0.2, 0.5, 0.8)}) if still else []
        chosen += [(a, b, i) for i in picks]
        (kept if picks else gone).append((a, b))
    return motion, limit, [tuple(x) for x in islands], spans, chosen, [(a, b, k + 1) for k, (a, b) in enumerate(kept)], gone


def recording(seed, n):
    """Stretches of rest, single jumps, long runs of movement, and one value for most of it."""
    r = random.Random(seed)
    out, level = [], 0.0
    while len(out) < n:
        kind = r.choice(["rest", "rest", "jump", "run"])
        if kind == "rest":
            out += [level] * r.randint(1, n // 3)
        elif kind == "jump":
            level += r.choice([-9.0, 9.0, 3.0])
        else:
            for _ in range(r.randint(2, n // 3)):
                level += 7.0
                out.append(level)
    return out[:n]


SERIES = {1: recording(1, 200), 2: recording(2, 61), 3: [5.0 * i for i in range(120)], 4: [1.0] * 90, 5: [0.0, 9.0], 6: [3.0], 7: recording(7, 90)}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(g, i, v) for g, vs in SERIES.items() for i, v in enumerate(vs)]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, "g long, idx long, signature double")


def everything(rows, by, pieces, most=selection.MOST):
    m = written(timeline.motion(dealt(rows, by, pieces), by), "motion")
    limits = timeline.threshold(m, by, most)
    found = written(timeline.islands(m, limits, by), "islands")
    spans = written(timeline.intervals(found, limits, by, m), "spans")
    chosen = written(timeline.samples(timeline.stable(m, limits, spans, by), by), "samples")
    kept, gone = timeline.segments(spans, chosen, by)
    parts = (m.select(*by, "idx", "motion"), limits.select(*by, "threshold"), found.select(*by, "start", "cut"), spans.select(*by, "left", "right"), chosen.select(*by, "left", "right", "idx"), kept.select(*by, "left", "right", "segment"), gone.select(*by, "left", "right"))
    return [sorted(map(tuple, p.collect())) for p in parts]


@pytest.mark.parametrize("pieces", FEW)
def test_keyed_series(series, pieces):
    motion, limits, found, spans, chosen, kept, gone = everything(series, ["g"], pieces)
    want = {g: brute(v) for g, v in SERIES.items()}
    assert motion == [(g, i, m) for g, w in sorted(want.items()) for i, m in enumerate(w[0])]
    assert limits == [(g, pytest.approx(w[1])) for g, w in sorted(want.items())]
    for got, k in ((found, 2), (spans, 3), (chosen, 4), (kept, 5), (gone, 6)):
        assert got == sorted((g, *x) for g, w in want.items() for x in w[k])


@pytest.mark.parametrize(("pieces", "g", "most"), [(1, 1, 20), (2, 1, selection.MOST), (50, 1, selection.MOST), (50, 3, selection.MOST), (50, 4, 20)])
def test_series_without_a_key(series, pieces, g, most):
    """Also one island over all pieces (3), and one stretch of rest over all (4)."""
    motion, limits, found, spans, chosen, kept, gone = everything(series.where(F.col("g") == g).drop("g"), [], pieces, most)
    want = brute(SERIES[g])
    assert [m for _, m in motion] == want[0] and limits == [(pytest.approx(want[1]),)]
    assert [found, spans, chosen, kept, gone] == [sorted(x) for x in want[2:]]


def test_vectors_in_pieces(spark):
    r = random.Random(8)
    vs = [[r.uniform(0, 9) for _ in range(5)] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(vs)), "idx long, signature array<double>")
    want = [0.0] + [sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 5 for a, b in zip(vs, vs[1:], strict=False)]
    for pieces in FEW:
        got = sorted(map(tuple, timeline.motion(dealt(df, [], pieces)).select("idx", "motion").collect()))
        assert [m for _, m in got] == pytest.approx(want)


@pytest.mark.parametrize("pieces", PIECES)
def test_scans(spark, pieces):
    r = random.Random(3)
    rows = {g: [(i, r.choice([None, None, r.randint(0, 9)])) for i in sorted(r.sample(range(900), n))] for g, n in enumerate([1, 2, 40, 150])}
    df = dealt(spark.createDataFrame([(g, i, v) for g, x in rows.items() for i, v in x], "g long, idx long, v int"), ["g"], pieces)
    out = scans.beside(df, ["g"], ["idx"], F.col("v"), "before")
    out = scans.beside(out, ["g"], ["idx"], F.col("idx"), "after", ahead=True)
    out = scans.numbered(scans.last_known(out, ["g"], ["idx"], F.col("v"), "last"), ["g"], ["idx"], "at")
    got = sorted(map(tuple, out.select("g", "idx", "before", "after", "last", "at").collect()))
    want = []
    for g, x in rows.items():
        last = None
        for k, (i, v) in enumerate(x):
            last = v if v is not None else last
            want.append((g, i, x[k - 1][1] if k else None, x[k + 1][0] if k + 1 < len(x) else None, last, k))
    assert got == want


def test_pieces_are_separate_tasks(spark):
    """No window runs over rows of more than a piece but the one over the pieces themselves."""
    df = scans.by_ranges(spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") % 7).cast("double").alias("signature")), [], "idx", 20)
    assert df.select(scans.PIECE).distinct().count() > 10
    plan = timeline.motion(df)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("_piece" in line for line in windows)


# ---- medians -------------------------------------------------------------------------------------------------------


def groups():
    r = random.Random(11)
    out = {
        "even": [float(i) for i in range(1000)],
        "odd": [float(i) for i in range(999)],
        "equal": [2.5] * 3000,
        "two": [1.0] * 1500 + [2.0] * 1500,
        "two and a bit": [1.0] * 1500 + [2.0] * 1501,
        "heavy low": [1.0] * 1500 + [r.uniform(1, 2) for _ in range(1500)],
        "heavy both": [1.0] * 1400 + [r.uniform(1, 2) for _ in range(200)] + [2.0] * 1400,
        "wide": [10.0 ** r.uniform(-300, 300) * r.choice([-1, 1]) for _ in range(2001)],
        "many": [r.gauss(0, 1) for _ in range(20_000)],
        "rounded": [round(r.gauss(0, 1), 1) for _ in range(20_000)],
        "one": [7.0],
        "nulls": [None] * 5 + [3.0, 4.0],
        "only nulls": [None, None],
        "infinite": [float("-inf")] * 30 + [float(i) for i in range(300)] + [float("inf")] * 40,
    }
    for k in range(12):
        out[f"random {k}"] = [float(r.choice([r.randint(0, 5), r.randint(0, 4000)])) for _ in range(r.randint(2, 3000))]
    return out


def test_medians(spark):
    rows = groups()
    df = spark.createDataFrame([(g, v) for g, vs in rows.items() for v in vs], "g string, v double")
    want = {g: (median(x) if (x := [v for v in vs if v is not None]) else None, len(vs)) for g, vs in rows.items()}
    for most in (50, 1):
        got = {x.g: (x["median"], x.n) for x in selection.medians(df, ["g"], "v", most).collect()}
        assert got.keys() == want.keys()
        for g, (m, n) in want.items():
            assert got[g] == ((pytest.approx(m) if m is not None else None), n), g


def test_median_of_a_table(spark):
    for g, vs in groups().items():
        if g in ("many", "heavy both"):
            df = spark.createDataFrame([(v,) for v in vs], "v double")
            assert selection.medians(df, [], "v", 10).first()["median"] == pytest.approx(median(vs)), g


def test_nearest_is_linear_in_a_key(spark):
    """Frames that begin at an end add up; one that ends there is built anew for each row."""
    points = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"))
    marks = points.where("t % 1000 = 500").select("k", F.col("t").alias("mark"))
    found = timeline.nearest(points, marks, ["k"])
    assert found.where("abs(t - mark) > 500").count() == 0 and found.count() == 60_000
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
