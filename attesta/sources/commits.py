"""Several outputs as one commit.

A set of outputs lives in one folder.  A writer puts each output's files into a folder of its own attempt, which readers don't
look at; only when all are written does it create the manifest, which names the attempt, and that file is the one switch that makes
the set visible.  It is created and never replaced, so of several writers one wins, and the others take their files away.  A writer that fails takes
its files away too; one that dies leaves files that no manifest names, and ``clean`` removes them.

``<path>/_set.json`` is the manifest {"attempt", "outputs": {name: {"rows", "schema"}}}; files lie in ``<path>/_attempts/<attempt>/<name>``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from attesta.sources import sinks

MANIFEST, ATTEMPTS = "_set.json", "_attempts"


def _root(path: str) -> str:
    return path.rstrip("/")


def _checked_names(outputs: dict[str, DataFrame]) -> None:
    if not outputs:
        raise ValueError("a set has one output at least")
    if bad := [n for n in outputs if not n or "/" in n or n.startswith(("_", "."))]:
        raise ValueError(f"no names of outputs: {', '.join(bad)}")


def write_set(outputs: dict[str, DataFrame], path: str, *, before: Callable[[str], None] | None = None) -> dict:
    """Writes all outputs to a new set and returns its manifest.  ``before`` is called with the name of each output ahead of it, and
    with "commit" ahead of the manifest; what it raises ends the attempt."""
    _checked_names(outputs)
    spark = next(iter(outputs.values())).sparkSession
    root, attempt = _root(path), uuid.uuid4().hex
    if committed(spark, path) is not None:
        raise FileExistsError(path)
    own = f"{root}/{ATTEMPTS}/{attempt}"
    try:
        listed = {}
        for name, df in outputs.items():
            if before:
                before(name)
            df.write.mode("errorifexists").parquet(f"{own}/{name}")
            listed[name] = {"rows": spark.read.schema(df.schema).parquet(f"{own}/{name}").count(), "schema": json.loads(df.schema.json())}
        manifest = {"attempt": attempt, "outputs": listed}
        if before:
            before("commit")
        if not sinks.create_file(spark, f"{root}/{MANIFEST}", json.dumps(manifest, sort_keys=True).encode()):
            raise FileExistsError(path)
    except BaseException:
        sinks.remove(spark, own)
        raise
    return manifest


def committed(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a set; None if there is none (yet)."""
    place = f"{_root(path)}/{MANIFEST}"
    return json.loads(sinks.read_text(spark, place)) if sinks._exists(spark, place) else None


def outputs(spark: SparkSession, path: str) -> list[str]:
    """The names of a set's outputs."""
    return sorted((committed(spark, path) or {"outputs": {}})["outputs"])


def read_output(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One output of a committed set."""
    manifest = committed(spark, path)
    if manifest is None or name not in manifest["outputs"]:
        raise FileNotFoundError(f"{path}: {name}")
    schema = T.StructType.fromJson(manifest["outputs"][name]["schema"])
    return spark.read.schema(schema).parquet(f"{_root(path)}/{ATTEMPTS}/{manifest['attempt']}/{name}")


def clean(spark: SparkSession, path: str) -> list[str]:
    """Removes what attempts without a commit have left in a committed set, and returns their names."""
    manifest = committed(spark, path)
    if manifest is None:
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{_root(path)}/{ATTEMPTS}")
    found = [s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    left = sorted(x for x in found if x != manifest["attempt"])
    for x in left:
        sinks.remove(spark, f"{_root(path)}/{ATTEMPTS}/{x}")
    return left


def next_set(spark: SparkSession, parent: str, name: str) -> str:
    """A path for a new set: ``parent/name``, or the first of ``name-2``, ``name-3`` ... that nobody has taken.  The caller holds it from now
    on: taking one is creating a file, which only one of several callers can."""
    n = 1
    while True:
        path = f"{_root(parent)}/{name}" + (f"-{n}" if n > 1 else "")
        if not sinks._exists(spark, f"{path}/{MANIFEST}") and sinks.create_file(spark, f"{path}/_taken", b""):
            return path
        n += 1


def last_set(spark: SparkSession, parent: str, name: str) -> str | None:
    """The last path that ``next_set`` gave; None if it gave none."""
    path, n = None, 1
    while sinks._exists(spark, f"{(at := f'{_root(parent)}/{name}' + (f'-{n}' if n > 1 else ''))}/_taken"):
        path, n = at, n + 1
    return path
