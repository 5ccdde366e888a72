"""Outputs that become visible together or not at all."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from attesta.sources import commits, sinks


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_all_outputs_or_none(spark, tmp_path):
    path = str(tmp_path / "set")
    a, b = rows(spark, 1, 2), rows(spark, 3).select("v", F.array("v").alias("list"), F.lit("x").cast("string").alias("s"))
    broken = b.withColumn("v", F.when(F.col("v") > 0, F.raise_error(F.lit("broken"))).cast("long"))
    with pytest.raises(Exception, match="broken"):
        commits.write_set({"a": a, "b": broken}, path)
    assert commits.committed(spark, path) is None and commits.outputs(spark, path) == [] and files(path) == []
    with pytest.raises(FileNotFoundError):
        commits.read_output(spark, path, "a")
    done = commits.write_set({"a": a, "b": b}, path)
    assert {k: v["rows"] for k, v in done["outputs"].items()} == {"a": 2, "b": 1}
    assert commits.outputs(spark, path) == ["a", "b"]
    assert commits.read_output(spark, path, "b").collect() == b.collect() and commits.read_output(spark, path, "b").dtypes == b.dtypes
    with pytest.raises(FileExistsError):
        commits.write_set({"a": b}, path)
    assert sorted(r.v for r in commits.read_output(spark, path, "a").collect()) == [1, 2]


@pytest.mark.parametrize("at", ["a", "b", "commit"])
def test_a_failure_at_any_point_leaves_nothing(spark, tmp_path, at):
    path = str(tmp_path / "set")

    def fail(step):
        if step == at:
            raise RuntimeError("injected")

    with pytest.raises(RuntimeError):
        commits.write_set({"a": rows(spark, 1), "b": rows(spark, 2)}, path, before=fail)
    assert commits.committed(spark, path) is None and files(path) == []


def test_of_two_callers_one_wins(spark, tmp_path):
    path, meet, out = str(tmp_path / "set"), threading.Barrier(2), {}

    def call(k):
        def wait(step):
            if step == "commit":
                meet.wait(60)

        try:
            commits.write_set({"a": rows(spark, k), "b": rows(spark, 10 * k)}, path, before=wait)
            out[k] = "won"
        except FileExistsError:
            out[k] = "lost"

    threads = [threading.Thread(target=call, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(out.values()) == ["lost", "won"]
    winner = next(k for k, v in out.items() if v == "won")
    assert [commits.read_output(spark, path, n).first().v for n in ("a", "b")] == [winner, 10 * winner]
    assert len({f.split("/")[1] for f in files(path)}) == 1  # the loser took its files away


def test_attempts_that_died_are_cleaned(spark, tmp_path):
    path = str(tmp_path / "set")
    rows(spark, 9).write.parquet(f"{path}/{commits.ATTEMPTS}/dead/a")
    assert commits.clean(spark, path) == [] and commits.committed(spark, path) is None
    commits.write_set({"a": rows(spark, 1)}, path)
    assert commits.read_output(spark, path, "a").count() == 1
    assert commits.clean(spark, path) == ["dead"] and commits.clean(spark, path) == []
    assert commits.read_output(spark, path, "a").count() == 1


def test_names(spark, tmp_path):
    for bad in ({}, {"": rows(spark, 1)}, {"a/b": rows(spark, 1)}, {"_a": rows(spark, 1)}):
        with pytest.raises(ValueError):
            commits.write_set(bad, str(tmp_path / "set"))


def test_numbers_are_taken_once(spark, tmp_path):
    parent, got = str(tmp_path), []
    threads = [threading.Thread(target=lambda: got.append(commits.next_set(spark, parent, "run"))) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == sorted([f"{parent}/run", *(f"{parent}/run-{n}" for n in range(2, 7))])
    assert commits.last_set(spark, parent, "run") == f"{parent}/run-6" and commits.last_set(spark, parent, "other") is None
    commits.write_set({"a": rows(spark, 1)}, got[0])
    assert commits.next_set(spark, parent, "run") == f"{parent}/run-7"


def test_plain_outputs_are_rolled_back(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    broken = rows(spark, 1).select(F.when(F.col("v") > 0, F.raise_error(F.lit("broken"))).cast("long").alias("v"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_all({a: rows(spark, 1), b: broken})
    assert not os.path.exists(a) and not os.path.exists(b) and not os.path.exists(f"{a}.claim")
    sinks.create_file(spark, f"{c}.claim", b"")  # another caller is at it
    with pytest.raises(FileExistsError):
        sinks.write_all({a: rows(spark, 1), c: rows(spark, 1)})
    assert not os.path.exists(a) and not os.path.exists(f"{a}.claim") and os.path.exists(f"{c}.claim")
    sinks.write_all({a: rows(spark, 1)})
    assert spark.read.parquet(a).count() == 1 and not os.path.exists(f"{a}.claim")
