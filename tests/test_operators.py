"""Operators on small cases, some against plain restatements of their rules with seeded random input."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attesta.operators import batches, cachelog, consensus, evaluation, geometry, quality, ranking, rewards, snapshots, timeline
from attesta.operators.snapshots import Snapshot

OBS = "key string, observation long, entity_id long, name string, screenshots array<string>, field string, value long, status string, images array<string>"
ENT = "key string, entity_id long, name string, identity_status string, extensions map<string,string>, sources array<struct<kind:string,uri:string,details:string>>"
READ = "key string, entity_id long, field string, value long, status string, sources array<struct<kind:string,uri:string,details:string>>"


def obs(i, value, image, entity=10001, key="v", status=None, field="level"):
    return (key, i, entity, "n", [f"s{image}"], field, value, status or ("unknown" if value is None else "observed"), [image])


@pytest.mark.parametrize(
    ("rows", "value", "status"),
    [
        ([obs(0, 90, "a")], 90, "observed"),
        ([obs(0, 90, "a"), obs(1, 90, "b")], 90, "confirmed"),
        ([obs(0, 90, "a"), obs(1, 90, "a")], 90, "observed"),
        ([obs(0, 90, "a"), obs(1, 90, "b"), obs(2, 80, "c")], None, "conflict"),
        ([obs(0, 90, "a"), obs(1, 80, "b", None)], 90, "observed"),
        ([obs(0, 90, "a", status="inferred"), obs(1, 90, "a", status="inferred")], 90, "inferred"),
        ([obs(0, None, "a", status="conflict"), obs(1, 90, "b"), obs(2, 90, "c")], None, "conflict"),
        ([obs(0, None, "a")], None, "unknown"),
    ],
)
def test_consensus(spark, rows, value, status):
    r = consensus.consensus(spark.createDataFrame(rows, OBS)).first()
    assert (r.value, r.status) == (value, status)


def test_identity_conflict_and_fields_of_others(spark):
    r = consensus.consensus(spark.createDataFrame([obs(0, None, "a", 1), obs(1, None, "b", 2)], OBS)).first()
    assert (r.entity_id, r.identity_status) == (None, "conflict")
    rows = [obs(0, 90, "a", 1), obs(1, 5, "b", None, field="gear")]
    got = {r.field: (r.value, r.status) for r in consensus.consensus(spark.createDataFrame(rows, OBS)).collect()}
    assert got == {"level": (90, "observed"), "gear": (None, "unknown")}


def test_visits_merge_and_single_ones_stay(spark):
    rows = [obs(0, 90, "a", key="v1"), obs(1, 90, "b", key="v2"), obs(2, 7, "c", None, key="v3")]
    got = {r.key: (r.value, r.status, r.identity_status) for r in consensus.merged_visits(consensus.consensus(spark.createDataFrame(rows, OBS))).collect()}
    assert got == {"entity_10001": (90, "confirmed", "confirmed"), "v3": (7, "observed", "unknown")}


def test_empty_consensus(spark):
    assert consensus.merged_visits(consensus.consensus(spark.createDataFrame([], OBS))).count() == 0


def snap(spark, entities, readings):
    return Snapshot(spark.createDataFrame([(k, i, n, s, x, []) for k, i, n, s, x in entities], ENT), spark.createDataFrame([(k, i, f, v, s, []) for k, i, f, v, s in readings], READ))


def base(spark, value=90, status="confirmed"):
    return snap(spark, [("entity_10001", 10001, "A", "confirmed", {"lock": "true"})], [("entity_10001", 10001, "level", value, status)])


@pytest.mark.parametrize(
    ("value", "status", "opt_in", "result", "result_status", "held"),
    [(None, "unknown", False, 90, "confirmed", 1), (91, "observed", False, 90, "confirmed", 1), (91, "observed", True, 91, "observed", 0), (91, "imported", False, 91, "imported", 0), (90, "observed", True, 90, "confirmed", 0)],
)
def test_merge_policy(spark, value, status, opt_in, result, result_status, held):
    incoming = snap(spark, [("x", 10001, "", "confirmed", {"lock": "false", "future": "1"})], [("x", 10001, "level", value, status)])
    m = snapshots.merge(base(spark), incoming, allow_observed=opt_in)
    r = m.snapshot.readings.first()
    assert (r.value, r.status) == (result, result_status)
    assert m.held.count() == held
    e = m.snapshot.entities.first()
    assert (e.name, e.extensions) == ("A", {"lock": "true", "future": "1"})


def test_merge_inserts_and_holds(spark):
    incoming = snap(spark, [("p", 10001, "A", "imported", {}), ("q", None, "", "unknown", {})], [("p", 10001, "level", 3, "imported")])
    m = snapshots.merge(snap(spark, [], []), incoming)
    assert [r.key for r in m.snapshot.entities.collect()] == ["entity_10001"]
    assert [(r.key, r.reason) for r in m.held.collect()] == [("q", "identity not accepted")]


def test_difference(spark):
    before = snap(spark, [("a", 1, "", "confirmed", {}), ("b", 2, "", "confirmed", {})], [("a", 1, "level", 90, "confirmed")])
    after = snap(spark, [("a", 1, "", "observed", {}), ("c", None, "", "unknown", {})], [("a", 1, "level", 90, "observed")])
    d = snapshots.difference(before, after)
    assert [(r.entity_id, r.side) for r in d.ids.collect()] == [(2, "missing")]
    assert [(r.before_status, r.after_status) for r in d.changes.collect()] == [("confirmed", "observed")]
    assert d.identity_changes.count() == 1
    assert [(r.side, r.key) for r in d.unresolved.collect()] == [("after", "c")]


@pytest.mark.parametrize(("patch", "fails"), [([("k", "level", 91)], False), ([("k", "level", None)], False), ([("k", "gear", 99)], True), ([("k", "no_field", 1)], True), ([("other", "level", 1)], True)])
def test_corrections(spark, patch, fails):
    have = spark.createDataFrame([("k", "level", 90, "observed")], "key string, field string, value long, status string")
    out = snapshots.corrected(have, spark.createDataFrame(patch, "key string, field string, value long"))
    if fails:
        with pytest.raises(PySparkException):
            out.collect()
    else:
        r = out.first()
        assert (r.value, r.status) == ((91, "corrected") if patch[0][2] else (None, "unknown"))


@pytest.mark.parametrize(("value", "status"), [(None, "confirmed"), (90, "unknown"), (90, "conflict"), (90, "made up")])
def test_value_status_violations(spark, value, status):
    assert quality.value_status(spark.createDataFrame([("k", 1, "level", value, status, [])], READ)).count() == 1


@pytest.mark.parametrize(("field", "value", "bad"), [("level", 0, 1), ("star", 6, 1), ("unknown_field", 1, 1), ("level", 100, 0), ("gear", None, 0)])
def test_bounds(spark, field, value, bad):
    assert quality.field_bounds(spark.createDataFrame([("k", 1, field, value, "observed", [])], READ)).count() == bad


def test_other_violations(spark):
    e = spark.createDataFrame([("a", 1, "", "confirmed", {}, []), ("b", 1, "", "confirmed", {}, []), ("c", None, "", "confirmed", {}, [])], ENT)
    assert quality.unique(e).count() == 1
    assert quality.identity(e).count() == 1
    cells = spark.createDataFrame([(0, 0, 3, "exact", 1, 0.9), (0, 1, None, "exact", 1, 0.9), (0, 2, 3, "abbreviated", 1, 0.9), (0, 3, 3, "exact", 11, 0.9)], "row int, col int, quantity long, quantity_status string, tier int, confidence double")
    assert quality.scanned_cells(cells).count() == 3
    bodies = spark.createDataFrame([("a", "json", bytearray(b"{}")), ("b", "json", bytearray(b"[]")), ("c", "image", bytearray(b"\xff\xd8\xff.......\xff\xd9")), ("d", "image", bytearray(b"x")), ("e", "json", bytearray(b""))], "url string, kind string, body binary")
    assert sorted(r.key for r in quality.payloads(bodies).collect()) == ["b", "d", "e"]
    assert [r.detail for r in quality.unexpected_keys(spark.createDataFrame([(1, '{"a":1,"z":2}')], "id int, j string"), "id", "j", ("a",)).collect()] == ["z"]
    assert quality.settings({"pace": 0.5, "retry_delay": 0.5, "ttl": float("nan")}) == ["retry_delay", "ttl"]


def test_rewards_rules(spark):
    r = spark.createDataFrame(
        [(1, "Item", 5, None, None, None, None, None, 2.0), (1, "GachaGroup", 9, 1.0, 3.0, None, 0.5, None, 2.0), (1, "Item", 6, None, None, 4.0, 0.0, None, 2.0), (1, "Item", 7, None, None, 4.0, 0.5, "FirstClear", 2.0), (1, "Item", 8, None, None, 4.0, None, "ThreeStar", 2.0)],
        "stage_id long, reward_kind string, reward_id long, amount_min double, amount_max double, amount double, chance double, reward_type string, factor double",
    )
    items = spark.createDataFrame([(9, "Item", 50, 1.0, 3.0, 0.5), (9, "Item", 51, 1.0, 1.0, 0.0)], "group_id long, item_type string, item_id long, item_min double, item_max double, item_chance double")
    got = {x.item_id: (x.expected, x.chance, x.source_group_id) for x in rewards.expectations(r, items, conditions=("FirstClear",)).collect()}
    assert got == {5: (2.0, 1.0, None), 50: (2.0, 0.25, 9), 7: (2.0, 0.5, None)}
    assert {x.item_id: float(x.expected) for x in rewards.totals_by_item(r, items, conditions=("FirstClear",)).collect()} == {5: 2.0, 50: 2.0, 7: 2.0}


REWARD = "stage_id long, category string, reward_kind string, reward_id long, amount_min double, amount_max double, amount double, chance double, reward_type string, factor double"
ITEM = "group_id long, item_type string, item_id long, item_min double, item_max double, item_chance double"


def _rewards(spark):
    r = random.Random(5)
    some = [(i, r.choice("ab"), r.choice(["GachaGroup", "GachaGroup", "Item"]), r.choice([1, 2, 3, None]), *r.choice([(1.0, 3.0, None), (None, None, 2.0), (None, 1.0, None)]), r.choice([None, 0.0, 1 / 3, 0.7]), r.choice([None, "FirstClear", "Other"]), r.choice([1.0, 1 / 7])) for i in range(300)]
    items = [(r.choice([1, 2, 4, None]), r.choice(["Item", "Part"]), r.choice([1, 2, 3, 4, None]), *r.choice([(1.0, 2.0), (0.0, 1 / 3), (None, 1.0)]), r.choice([0.0, 0.25, 1.0])) for _ in range(60)]
    return spark.createDataFrame(some, REWARD), spark.createDataFrame(items, ITEM)


def _rounded(r, items, *by):
    """What single rows sum up to, from the rows of a plain join."""
    chance, rolls = F.coalesce("chance", F.lit(1.0)), F.when(F.col("amount_min").isNotNull() & F.col("amount_max").isNotNull(), (F.col("amount_min") + F.col("amount_max")) / 2).otherwise(F.coalesce("amount", F.lit(1.0))) * F.coalesce("chance", F.lit(1.0))
    known = r.where("reward_type is null or reward_type = 'FirstClear'").withColumns({"r": rolls, "p": chance, "f": F.when(F.col("reward_type").isNull(), F.col("factor")).otherwise(1.0)})
    direct = known.where("reward_kind <> 'GachaGroup' and p > 0").select("category", F.col("reward_kind").alias("item_type"), F.col("reward_id").alias("item_id"), (F.col("r") * F.col("f")).alias("e"))
    opened = known.where("reward_kind = 'GachaGroup' and r <> 0").join(items, F.col("reward_id") == F.col("group_id")).where("p * item_chance > 0")
    rows = direct.unionByName(opened.select("category", "item_type", "item_id", (F.col("r") * ((F.col("item_min") + F.col("item_max")) / 2 * F.col("item_chance")) * F.col("f")).alias("e")))
    return Counter(map(tuple, rows.groupBy(*by).agg(F.count(F.lit(1)), F.sum(F.round("e", 6).cast("decimal(18,6)")).cast("double")).collect()))


def _totals(r, items, each_item):
    found = rewards.rounded_totals(r, items, ("category",), conditions=("FirstClear",), each_item=each_item)
    return Counter(map(tuple, found.withColumn("expected", F.col("expected").cast("double")).collect()))


def test_totals_by_type_without_rows(spark):
    r, items = _rewards(spark)
    assert _totals(r, items, False) == _rounded(r, items, "category", "item_type")


def test_totals_by_item_without_rows(spark):
    r, items = _rewards(spark)
    assert _totals(r, items, True) == _rounded(r, items, "category", "item_type", "item_id")


def test_expectations_by_class(spark, monkeypatch):
    r, items = _rewards(spark)
    monkeypatch.setattr(rewards, "CHUNK", 2)
    found = rewards.expectations(r, items, conditions=("FirstClear",), keep=("category",), places=6)
    for by in (["category", "item_type"], ["category", "item_type", "item_id"]):
        assert Counter(map(tuple, found.groupBy(*by).agg(F.count(F.lit(1)), F.sum(F.col("expected").cast("decimal(18,6)")).cast("double")).collect())) == _rounded(r, items, *by)


def test_unknown_stage_stops(spark):
    stages, wanted = spark.createDataFrame([(1,)], "stage_id long"), spark.createDataFrame([(0, 1), (1, 1), (2, 7)], "ordinal long, stage_id long")
    assert rewards.selected_stages(stages, wanted.where("stage_id = 1")).count() == 2
    with pytest.raises(PySparkException):
        rewards.selected_stages(stages, wanted).collect()


def plan(values, q=(0.2, 0.5, 0.8)):
    """The selection, restated: (threshold, {(left, right): samples}, discarded)."""
    motion = [0.0] + [abs(a - b) for a, b in zip(values[1:], values, strict=False)]
    med = statistics.median(motion)
    limit = max(1.5, min(5.0, med + 8 * max(statistics.median(abs(m - med) for m in motion), 0.05)))
    changed = [i for i, m in enumerate(motion) if m > limit]
    cuts = sorted({0, len(values), *(i for i in changed if i + 1 not in changed)})
    kept, gone = {}, []
    for a, b in zip(cuts, cuts[1:], strict=False):
        ok = [i for i in range(a + 1, b - 1) if motion[i] < 0.35 * limit and motion[i + 1] < 0.35 * limit]
        if ok:
            kept[a, b] = sorted({ok[round(x * (len(ok) - 1))] for x in q})
        else:
            gone.append((a, b))
    return limit, kept, gone


@pytest.mark.parametrize("seed", range(4))
def test_selection(spark, seed):
    r = random.Random(seed)
    values = [x + r.gauss(0, 0.1) for _ in range(30) for x in [r.uniform(0, 100)] for _ in range(r.randint(1, 29))]
    series = spark.createDataFrame(list(enumerate(values)), "idx long, signature double")
    m = timeline.motion(series)
    limits = timeline.threshold(m)
    spans = timeline.intervals(timeline.islands(m, limits), limits)
    chosen = timeline.samples(timeline.stable(m, limits, spans))
    limit, kept, gone = plan(values)
    assert limits.first().threshold == pytest.approx(limit)
    got = {}
    for x in chosen.collect():
        got.setdefault((x.left, x.right), []).append(x.idx)
    assert {k: sorted(v) for k, v in got.items()} == kept
    _, discarded = timeline.segments(spans, chosen)
    assert sorted((x.left, x.right) for x in discarded.collect()) == gone


def test_motion_of_vectors(spark):
    s = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 3.0])], "idx long, signature array<double>")
    assert [r.motion for r in timeline.motion(s).orderBy("idx").collect()] == [0.0, 2.0]


def test_as_of_and_nearest(spark):
    frames = spark.createDataFrame([(0.0, 1), (0.4, 2), (1.0, 3)], "ts double, frame long")
    grid = spark.createDataFrame([(0.4,), (0.39,), (2.0,)], "ts double")
    assert {r.ts: r.frame for r in timeline.as_of(grid, frames).collect()} == {0.4: 2, 0.39: 1, 2.0: 3}
    points, marks = spark.createDataFrame([("a", 1.0), ("a", 1.6), ("a", 9.0)], "g string, t double"), spark.createDataFrame([("a", 0.0), ("a", 2.0)], "g string, mark double")
    assert {r.t: r.mark for r in timeline.nearest(points, marks, ["g"]).collect()} == {1.0: 0.0, 1.6: 2.0, 9.0: 2.0}


EVAL = "value long, prediction string, score double, margin double"
CASES = [(1, "1", 0.99, 0.2), (2, "3", 0.99, 0.2), (4, "4", 0.2, 0.2), (None, "8", 0.99, 0.2), (None, None, 0.0, 0.2)]


def test_metrics(spark):
    m = evaluation.metrics(spark.createDataFrame(CASES, EVAL), 0.9, 0.1).first()
    assert (m.numeric_n, m.correct, m.wrong, m.abstained, m.accepted_accuracy, m.control_n, m.control_false_accepts) == (3, 1, 1, 1, 0.5, 2, 1)
    m = evaluation.metrics(spark.createDataFrame(CASES, EVAL), 1.01, 1.0).first()
    assert (m.correct_rate, m.accepted_accuracy) == (0, None)


def test_calibration(spark):
    best = evaluation.calibrate(spark.createDataFrame([(1, "1", 0.95, 0.2), (None, "1", 0.99, 0.3)], EVAL)).first()
    assert (best.score, best.margin, best.correct) == (1.01, 1.0, 0)
    r = random.Random(5)
    rows = [(r.choice([0, 1, None]), r.choice(["0", "1", None]), r.randint(40, 100) / 100, r.randint(0, 40) / 100) for _ in range(60)]
    rows += [(1, "1", 0.9, 0.25)] * 300
    want = (0, 0, 1.01, 1.0)
    for s in range(50, 101):
        for m in range(31):
            ok = [(v, p) for v, p, a, b in rows if p is not None and a >= s / 100 and b >= m / 100]
            right = sum(v is not None and p == str(v) for v, p in ok)
            if len(ok) - right <= 0.01 * len(ok):
                want = max(want, (right, -(len(ok) - right), s / 100, m / 100))
    got = evaluation.calibrate(spark.createDataFrame(rows, EVAL)).first()
    assert (got.correct, -got.mistakes, got.score, got.margin) == want


def test_ranking(spark):
    scores = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.9), (1, "c", 0.1), (2, "a", 0.5)], "query long, label string, score double")
    got = {r["query"]: (r.label, r.margin) for r in ranking.top_with_margin(scores, alone=1.0).collect()}
    assert got == {1: ("a", 0.0), 2: ("a", 1.0)}
    assert spark.range(1).select(ranking.decided(F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(20), F.lit(11)).alias("x")).first().x == "key-points"
    labels = spark.createDataFrame([("3", "gear"), ("2", "gear"), ("MAX", "ex"), ("6", "ex")], "l string, f string")
    assert [r.x for r in labels.select(ranking.capped(F.col("l"), F.col("f")).alias("x")).collect()] == [None, "2", "MAX", None]


CACHE = "id long, url string, kind string, at double, status string, sha256 string, size long, error string, http_status int, retry_after double"


def ev(i, status, sha=None, at=None, url="https://h.example/a", http=None, after=None):
    return (i, url, "json", float(i if at is None else at), status, sha, 1, None, http, after)


def test_cache_replay(spark):
    log = [ev(0, "downloaded", "A"), ev(1, "not-modified", "A"), ev(2, "failed", http=503, after=900.0), ev(3, "failed", http=503)]
    e = cachelog.entries(spark.createDataFrame(log, CACHE)).first()
    assert (e.sha256, e.failures, e.checked_at, e.retry_at) == ("A", 2, 1.0, 603.0)
    e = cachelog.entries(spark.createDataFrame([*log, ev(4, "downloaded", "B")], CACHE)).first()
    assert (e.sha256, e.failures, e.retry_at) == ("B", 0, None)
    assert cachelog.host_blocks(spark.createDataFrame(log, CACHE)).first().blocked_until == 902.0
    assert cachelog.versions(spark.createDataFrame(log, CACHE)).first().last_seen == 1.0


@pytest.mark.parametrize(
    ("mode", "valid", "fresh", "retry", "entry", "seed", "want"),
    [("auto", True, True, 0.0, True, False, "hit"), ("offline", False, True, 0.0, True, False, "error"), ("offline", True, True, 0.0, True, False, "offline-hit"), ("auto", True, False, 9.0, True, False, "stale-backoff"), ("auto", False, False, 9.0, True, False, "error"), ("auto", True, False, 0.0, True, False, "conditional-get"), ("auto", False, False, 0.0, False, False, "get"), ("auto", False, False, 0.0, False, True, "adopt")],
)
def test_cache_decisions(spark, mode, valid, fresh, retry, entry, seed, want):
    d = cachelog.decision(F.lit(mode), F.lit(valid), F.lit(fresh), F.lit(retry), F.lit(None).cast("double"), F.lit(5.0), F.lit(entry), F.lit(seed))
    assert spark.range(1).select(d.alias("x")).first().x == want


def test_batches(spark):
    rows = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "ordinal long, digest string")
    kept, gone = batches.keep_first(rows, "digest", "ordinal")
    assert sorted(r.ordinal for r in kept.collect()) == [0, 1]
    assert [r.ordinal for r in gone.collect()] == [2]
    b = lambda x: batches.fingerprint(spark.createDataFrame([(1, i, d) for i, d in enumerate(x)], "b int, o int, d string"), ["b"], "d", "o").first().fingerprint
    assert b("abc") == b("abc") != b("acb")
    assert batches.bad_timestamps(spark.createDataFrame([(float("nan"),), (float("inf"),), (-1.0,), (2.0,), (None,)], "timestamp double")).count() == 3
    files = spark.createDataFrame([("a.json", 1), ("A.json", 1), ("../x", 1)], "name string, size long")
    assert sorted(r.rule for r in batches.manifest_problems(files, ("need.json",)).collect()) == ["names differ by case only", "required file is missing", "unsafe name"]
    have = batches.category_totals(spark.createDataFrame([("c", 3), ("c", None), ("d", None)], "category string, quantity long"))
    assert {r.category: (r.cells, r.known, r.quantity) for r in have.collect()} == {"c": (2, 1, 3), "d": (1, 0, 0)}


def test_geometry(spark):
    v = spark.range(1).select(geometry.line_groups(F.array(*map(F.lit, (10.0, 11.0, 30.0, 12.0, 31.0))), F.lit(5.0)).alias("g")).first().g
    assert v == [11.0, 30.5]
    boxes = [(1, 10.0 + 100 * c, 10.0 + 120 * r, 80.0, 100.0) for r in range(2) for c in range(3)] + [(1, 12.0, 12.0, 70.0, 90.0), (1, 500.0, 500.0, 20.0, 20.0)]
    df = spark.createDataFrame(boxes, "image_id long, x double, y double, width double, height double")
    left = geometry.suppressed(df)
    assert left.count() == 7
    sizes = geometry.card_sizes(left)
    assert (sizes.first().width, sizes.first().members) == (80.0, 6)
    cells = geometry.grid_cells(left.where("width = 80"), sizes)
    assert sorted((r.row, r.col) for r in cells.collect()) == [(r, c) for r in range(2) for c in range(3)]
    frames = spark.createDataFrame([(0, 4, 2, bytearray([0, 0, 8, 8, 0, 0, 8, 8]))], "idx int, width int, height int, pixels binary")
    assert geometry.frame_signatures(frames, (1, 2)).first().signature == [0.0, 8.0]


def test_early_stop(spark):
    h = spark.createDataFrame([("r", i, m) for i, m in enumerate([0.1, 0.3, 0.3, 0.2, 0.4])], "run string, epoch long, metric double")
    assert [r.stale for r in timeline.early_stop(h, ["run"], 2).orderBy("epoch").collect()] == [0, 0, 1, 2, 0]


# ---- intervals -----------------------------------------------------------------------------------------------------


def test_nodes_cover_each_bucket_once(spark):
    r = random.Random(6)
    ends = [(a := r.randint(-60, 60), a + r.randint(0, 120)) for _ in range(150)] + [(0, 0), (-1, 0), (7, 7), (0, 127), (-(1 << 40), (1 << 41) + 5)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ends)], "i long, a long, b long")
    for x in df.withColumn("n", timeline.nodes(F.col("a"), F.col("b"))).collect():
        held = sorted((n.place << n.level, (n.place + 1) << n.level) for n in x.n)
        assert held[0][0] == x.a and held[-1][1] == x.b + 1 and all(p[1] == q[0] for p, q in zip(held, held[1:], strict=False))
        assert len(x.n) <= 2 * max(1, (x.b - x.a + 1).bit_length())


def test_intervals_of_any_length(spark):
    r = random.Random(2)
    spans = [(k, a := r.uniform(-500, 500), a + r.choice([0.0, 0.5, 3.0, 40.0, 900.0, 1e6])) for k in range(80)] + [(90, -1e9, 1e9), (91, 5.0, 4.0), (92, 7.0, 7.0)]
    points = [(i, r.choice([r.uniform(-600, 600), float(r.randint(-600, 600)), r.uniform(-2e6, 2e6)])) for i in range(300)] + [(900, a) for _, a, _ in spans[:3]] + [(901, b) for _, _, b in spans[:3]]
    p, s = spark.createDataFrame(points, "i long, t double"), spark.createDataFrame(spans, "k long, a double, b double")
    want = sorted((i, t, k) for i, t in points for k, a, b in spans if a <= t < b)
    for width in (0.7, 50.0, 1e5):
        got = timeline.in_interval(p, s, F.col("t"), F.col("a"), F.col("b"), width)
        assert sorted(map(tuple, got.select("i", "t", "k").collect())) == want
    whole = spark.range(1).select(F.lit(0.0).alias("a"), F.lit(86400.0 * 365 * 100).alias("b"))  # a century in buckets of a second
    assert whole.select(F.size(timeline.nodes(F.floor("a"), F.floor("b")))).first()[0] < 100
    assert timeline.in_interval(p, s.where("false"), F.col("t"), F.col("a"), F.col("b"), 1.0).count() == 0
