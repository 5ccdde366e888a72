"""Bundles of resources: packed, checked and installed by content.

An installed bundle is a Parquet table (name, size, data) in a folder named by its manifest's hash; a pointer tells which one is
current.  Installing the same bundle twice changes nothing, and a reader never sees half of one.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.batches import manifest_differences
from attesta.sources import readers, sinks


def checked(files: DataFrame) -> tuple[DataFrame, str]:
    """(members without the manifest, the manifest's hash); a manifest that doesn't agree with the members is an error."""
    held = files.where("name = 'manifest.json'").first()
    if held is None:
        raise ValueError("the bundle has no manifest")
    manifest = json.loads(bytes(held.data))
    if not isinstance(manifest, dict) or manifest.get("schema_version") != 1 or not isinstance(manifest.get("files"), dict):
        raise ValueError("the manifest's format is unknown")
    listed = files.sparkSession.createDataFrame([(k, v["sha256"]) for k, v in manifest["files"].items()], "name string, sha256 string")
    members = files.where("name <> 'manifest.json'")
    if wrong := manifest_differences(listed, members.select("name", F.sha2("data", 256).alias("sha256"))).limit(5).collect():
        raise ValueError("; ".join(f"{r.state}: {r.name}" for r in wrong))
    return members, hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()


def install(spark: SparkSession, path: str, root: str, **pinned: str | int) -> str:
    """Installs a bundle and makes it the current one; returns its name.  ``pinned`` may give its sha256 and size."""
    members, name = checked(readers.bundle(spark, path, **pinned))
    target = f"{root.rstrip('/')}/bundles/{name}"
    if not sinks._exists(spark, f"{target}/_SUCCESS"):
        members.write.mode("overwrite").parquet(target)
    sinks.create_file(spark, f"{root.rstrip('/')}/current.json", json.dumps({"bundle": name}).encode(), overwrite=True)
    return name


def installed(spark: SparkSession, root: str) -> tuple[str, DataFrame]:
    """(name, members) of the current bundle."""
    pointer = f"{root.rstrip('/')}/current.json"
    if not sinks._exists(spark, pointer):
        raise ValueError("no bundle is installed")
    name = json.loads(sinks.read_text(spark, pointer))["bundle"]
    return name, spark.read.schema("name string, size long, data binary").parquet(f"{root.rstrip('/')}/bundles/{name}")
