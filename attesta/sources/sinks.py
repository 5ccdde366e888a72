"""Sinks that never overwrite: every target is checked before anything is written."""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import escaped


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file on any of Spark's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_file(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> bool:
    """Writes a small file; False, and nothing written, if it exists and must not be replaced.  Only one of several callers creates
    it: a distributed file system sees to that, on a local one the operating system does."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file" and not overwrite:
        own = place.toUri().getPath()
        os.makedirs(os.path.dirname(own), exist_ok=True)
        try:
            with open(own, "xb") as f:
                f.write(data)
        except FileExistsError:
            return False
        return True
    try:
        stream = system.create(place, overwrite)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def modified(spark: SparkSession, path: str) -> float | None:
    """Epoch seconds of a file's last change; None if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(place).getModificationTime() / 1000 if system.exists(place) else None


def check_new(spark: SparkSession, paths: list[str]) -> None:
    """Stops unless all paths are distinct and none exists."""
    if len(set(paths)) != len(paths):
        raise ValueError("outputs must be distinct")
    if taken := [p for p in paths if _exists(spark, p)]:
        raise FileExistsError(", ".join(taken))


def write_all(outputs: dict[str, DataFrame], kind: str = "parquet") -> None:
    """Writes each DataFrame to its path; all targets are checked first, so none is written if one exists.

    Each path is claimed by a file beside it while the call lasts, so of two callers one is refused; if an output fails, those before it
    go.  Where readers must never see a part of the outputs, even of a caller that dies, ``commits.write_set`` is the way."""
    spark = next(iter(outputs.values())).sparkSession
    check_new(spark, list(outputs))
    claims: list[str] = []
    made: list[str] = []
    try:
        for path in outputs:
            claim = f"{path.rstrip('/')}.claim"
            if not create_file(spark, claim, b""):
                raise FileExistsError(path)
            claims.append(claim)
        check_new(spark, list(outputs))  # another caller may have ended meanwhile
        for path, df in outputs.items():
            made.append(path)
            df.write.mode("errorifexists").format(kind).save(path)
    except BaseException:
        for path in made:
            remove(spark, path)
        raise
    finally:
        for claim in claims:
            remove(spark, claim)


def write_with_report(df: DataFrame, path: str, report: dict, kind: str = "json") -> str:
    """Writes ``df`` and, beside it, a report; returns the report's path."""
    spark = df.sparkSession
    side = f"{path.rstrip('/')}.report"
    check_new(spark, [path, side])
    df.write.mode("errorifexists").format(kind).save(path)
    spark.createDataFrame([(json.dumps(report, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("errorifexists").text(side)
    return side


def write_blobs(bodies: DataFrame, path: str) -> None:
    """A content-addressed store: each body (sha256, body) once, in a folder by the first two characters of its hash."""
    once = bodies.dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
    once.write.mode("append").partitionBy("prefix").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def numbered_output(spark: SparkSession, parent: str, name: str, resume: bool = False) -> str:
    """``parent/name``, or the first free ``name-2``, ``name-3`` ...; with ``resume`` the last one that exists."""
    base = str(PurePosixPath(parent) / name) if "://" not in parent else f"{parent.rstrip('/')}/{name}"
    path, n = base, 1
    while _exists(spark, path):
        n += 1
        nxt = f"{base}-{n}"
        if resume and not _exists(spark, nxt):
            return path
        path = nxt
    return path


def write_extraction(path: str, *, segments: DataFrame, observations: DataFrame, results: DataFrame, review: DataFrame) -> dict:
    """The four outputs of an extraction as one commit; ``commits.read_output`` reads them."""
    from attesta.sources.commits import write_set

    return write_set({"segments": segments, "observations": observations, "results": results, "review": review}, path)


def pack(files: DataFrame, path: str) -> str:
    """Packs files (name, data) into a ZIP bundle at a new path, with a manifest of their sizes and hashes; returns the bundle's
    hash.  Members stand in order of their names and have no time, so equal files make equal bundles.  For the few files of a
    package, which pass through the driver."""
    spark = files.sparkSession
    check_new(spark, [path])
    held = sorted((r.name, bytes(r.data)) for r in files.select("name", "data").collect())
    listed = {name: {"sha256": hashlib.sha256(data).hexdigest(), "size": len(data)} for name, data in held}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in [("manifest.json", json.dumps({"schema_version": 1, "files": listed}, sort_keys=True, indent=2).encode()), *held]:
            archive.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    if not create_file(spark, path, out.getvalue()):
        raise FileExistsError(path)
    return hashlib.sha256(out.getvalue()).hexdigest()


def write_page(df: DataFrame, path: str, title: str, limit: int = 10_000) -> None:
    """A table as one static HTML page in a new folder; at most ``limit`` rows, in the order of ``df``."""
    spark = df.sparkSession
    check_new(spark, [path])
    cell = lambda tag, c: F.concat(F.lit(f"<{tag}>"), escaped(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))
    plain = lambda c: F.to_json(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string")
    rows = df.limit(limit).select(F.concat(F.lit("<tr>"), *(cell("td", plain(c)) for c in df.columns), F.lit("</tr>")).alias("value"))
    lines = [r.value for r in rows.collect()]  # at most ``limit``
    shown = spark.range(1).select(F.concat(F.lit("<tr>"), *(cell("th", F.lit(c)) for c in df.columns), F.lit("</tr>")).alias("h"), escaped(F.lit(title)).alias("t")).first()
    body = "\n".join([f"<!doctype html><html><head><meta charset=utf-8><title>{shown.t}</title></head><body><h1>{shown.t}</h1><table>", shown.h, *lines, "</table></body></html>"])
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(path)
