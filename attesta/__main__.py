"""``python -m attesta``: catalogues, collections, extractions, rewards, the cache and bundles from the command line.

A snapshot is a folder with ``entities`` and ``readings``.  No command overwrites anything.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import batches, cachelog, consensus, evaluation, quality, rewards, snapshots
from attesta.operators.snapshots import Snapshot
from attesta.schemas import SCHEMAS
from attesta.sources import bundles, cached, codec, commits, readers, sinks


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("attesta").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _load(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot folder, or an account file."""
    if path.endswith(".json"):
        return readers.account(spark, path)
    return Snapshot(commits.read_output(spark, path, "entities"), commits.read_output(spark, path, "readings"))


def _save(snapshot: Snapshot, path: str, **more: DataFrame) -> None:
    commits.write_set({"entities": snapshot.entities, "readings": snapshot.readings, **more}, path)


def _wire(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.lit(path).alias("source"), F.col("value").alias("text"))
    if problems := codec.problems(text).limit(5).collect():
        raise ValueError("; ".join(p.problem for p in problems))
    return text


def _show(df: DataFrame, limit: int = 1000) -> None:
    for row in df.limit(limit).toJSON().collect():
        print(row)


def fetch(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_all({a.output: readers.fetched_catalogue(spark, a.base, a.dataset, a.region)})


def import_(spark: SparkSession, a: argparse.Namespace) -> None:
    names = readers.catalogue(spark, a.catalogue, "students", "jp").select("id", "name") if a.catalogue else None
    _save(codec.from_wire(_wire(spark, a.input), names), a.output)


def from_extraction(spark: SparkSession, a: argparse.Namespace) -> None:
    _save(codec.from_extraction(spark.read.parquet(a.input)), a.output)


def diff(spark: SparkSession, a: argparse.Namespace) -> None:
    d = snapshots.difference(_load(spark, a.before), _load(spark, a.after))
    for name in d._fields:
        _show(getattr(d, name).withColumn("part", F.lit(name)), a.limit)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    m = snapshots.merge(_load(spark, a.base), _load(spark, a.incoming), allow_observed=a.allow_observed)
    _save(m.snapshot, a.output, applied=m.applied, held=m.held)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    text, report = codec.export(_load(spark, a.input), _wire(spark, a.base) if a.base else None, allow_observed=a.allow_observed)
    sinks.check_new(spark, [a.output, f"{a.output}.report"])
    text.coalesce(1).write.text(a.output)
    report.write.json(f"{a.output}.report")


def calculate(spark: SparkSession, a: argparse.Namespace) -> None:
    stage = readers.typed(readers.catalogue(spark, a.stages, "stages", a.region), SCHEMAS["stages"])
    group = readers.typed(readers.catalogue(spark, a.groups, "groups", a.region), SCHEMAS["groups"])
    if a.ids:
        if any(i <= 0 for i in a.ids):
            raise ValueError("ids must be positive")
        wanted = spark.createDataFrame(list(enumerate(a.ids)), "ordinal long, stage_id long")
        stage = rewards.selected_stages(stage.withColumnRenamed("id", "stage_id"), wanted)
    else:
        stage = rewards.selected_stages(stage.withColumnRenamed("id", "stage_id"), None)
    factor = rewards.multiplier(F.col("Category"), F.col("Difficulty"))
    r = stage.select("ordinal", "stage_id", factor.alias("factor"), F.explode(rewards.chosen_rewards(F.col("Rewards"), F.col("ServerData"), a.server)).alias("r"))
    r = r.select("ordinal", "stage_id", F.col("r.Type").alias("reward_kind"), F.col("r.Id").alias("reward_id"), F.col("r.AmountMin").alias("amount_min"), F.col("r.AmountMax").alias("amount_max"), F.col("r.Amount").alias("amount"), F.col("r.Chance").alias("chance"), F.col("r.RewardType").alias("reward_type"), "factor")
    chosen = rewards.group_items(F.col("Items"), F.col("ItemsGlobal"), F.col("ItemsCn"), a.server)
    items = group.select(F.col("id").alias("group_id"), F.explode(chosen).alias("i")).select("group_id", F.col("i.Type").alias("item_type"), F.col("i.Id").alias("item_id"), F.col("i.AmountMin").alias("item_min"), F.col("i.AmountMax").alias("item_max"), F.col("i.Chance").alias("item_chance"))
    _show(rewards.expectations(r, items, conditions=tuple(a.condition), keep=("ordinal", "stage_id")).orderBy("ordinal", "item_type", "item_id"), a.limit)


def _now(a: argparse.Namespace) -> float:
    return a.now if a.now is not None else datetime.now(UTC).timestamp()


def cache_log(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reports of the log in a cache's folder."""
    log = cached.Cache(spark, a.folder).events()
    if a.what == "info":
        _show(cachelog.totals(log))
        _show(cachelog.listed(cachelog.entries(log)), a.limit)
    elif a.what == "history":
        _show(cachelog.history(log, a.url, a.limit))
    elif a.what == "versions":
        _show(cachelog.versions(log), a.limit)
    else:
        _show(cachelog.due(cachelog.entries(log), _now(a)), a.limit)


def cache_get(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prints a resource's status and size; it is asked for if the policy and the log say so."""
    try:
        found = cached.Cache(spark, a.folder).get(a.url, cached.http(), _now(a), kind=a.kind, mode=a.mode, clock=time.time if a.now is None else None)
    except cached.CacheMiss as e:
        raise ValueError(f"not cached: {e}") from e
    print(json.dumps({"status": found.status, "size": len(found.body)}))


def cache_verify(spark: SparkSession, a: argparse.Namespace) -> None:
    report = cached.Cache(spark, a.folder).verify()
    print(json.dumps(report))
    if not report["ok"]:
        raise ValueError("the cache is damaged")


def cache_policy(spark: SparkSession, a: argparse.Namespace) -> None:
    """Shows the policy, after the changes that are given."""
    held = cached.Cache(spark, a.folder)
    changes = {k: v for k in cached.Policy._fields if (v := getattr(a, k)) is not None}
    print(json.dumps((held.configure(**changes) if changes else held.policy())._asdict()))


def cache_update(spark: SparkSession, a: argparse.Namespace) -> None:
    report = cached.Cache(spark, a.folder).update(cached.http(), _now(a), refresh=a.refresh)
    print(json.dumps(report))
    if {"failed", "stale-error", "stale-backoff"} & report.keys():
        raise ValueError("not all resources could be updated")


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Readings of observations, as a table, to entities: rejected ones go, visits are judged, then entities; all of it is written."""
    rows = spark.read.parquet(a.input)
    if missing := [c for c in consensus.COLUMNS if c not in rows.columns]:
        raise ValueError(f"the observations lack {', '.join(missing)}")
    good, bad = consensus.split_observations(rows) if "rejection" in rows.columns else (rows, rows.limit(0).withColumn("rejection", F.lit("")))
    visits = consensus.consensus(good.select(consensus.COLUMNS))
    entities = consensus.merged_visits(visits)
    if a.corrections:
        fixed = snapshots.corrected(entities.where("field is not null").select("key", "field", "value", "status"), readers.corrections(spark, a.corrections))
        people = entities.select("key", "entity_id", "name", "identity_status", "screenshots", "observations").distinct()
        evidence = entities.where("field is not null").select("key", "field", "images")
        entities = people.join(fixed, "key", "left").join(evidence, ["key", "field"], "left").select(entities.columns)
    sinks.write_extraction(a.output, segments=consensus.by_quality(consensus.frame_quality(good)), observations=good.unionByName(bad, allowMissingColumns=True), results=entities, review=consensus.review_queue(entities))
    _show(consensus.identified(commits.read_output(spark, a.output, "results")))


def inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    """What an extraction found, and what needs review; as a page too, if one is asked for."""
    results = commits.read_output(spark, a.input, "results")
    _show(consensus.review_summary(results))
    _show(consensus.status_histogram(results).orderBy("status"))
    _show(consensus.final_values(results).orderBy("key"), a.limit)
    if a.page:
        sinks.write_page(results.orderBy("key", "field"), a.page, a.input)


def doctor(spark: SparkSession, a: argparse.Namespace) -> None:
    """Whether an extraction is sound: the rules that its snapshot breaks, and how often."""
    found = codec.from_extraction(commits.read_output(spark, a.input, "results"))
    broken = quality.snapshot_violations(found.entities, found.readings).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy("rule").collect()
    print(json.dumps({"spark": spark.version, "ok": not broken, "broken": {r.rule: r.n for r in broken}}))
    if broken:
        raise ValueError("the extraction breaks rules")


def export_extraction(spark: SparkSession, a: argparse.Namespace) -> None:
    """An extraction as a wire collection."""
    text, report = codec.export(codec.from_extraction(commits.read_output(spark, a.input, "results")), _wire(spark, a.base) if a.base else None, allow_observed=a.allow_observed)
    sinks.check_new(spark, [a.output, f"{a.output}.report"])
    text.coalesce(1).write.text(a.output)
    report.write.json(f"{a.output}.report")


def scan(spark: SparkSession, a: argparse.Namespace) -> None:
    """Totals by category of a table of inventory cells (category, quantity); against expected cells, if given, on (row, col)."""
    cells = spark.read.parquet(a.input)
    if a.output:
        sinks.write_all({a.output: cells})
    _show(batches.category_totals(cells).orderBy("category"))
    if a.expected:
        compared = evaluation.compared_cells(spark.read.parquet(a.expected), cells.select("row", "col", "quantity"), ["row", "col"], ["quantity"])
        _show(evaluation.validation_report(compared, "quantity"))


def assets_pack(spark: SparkSession, a: argparse.Namespace) -> None:
    """Packs the files of a folder, whose names must be safe."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(a.folder)
    root = found.select(F.input_file_name()).limit(1).collect()
    if not root:
        raise ValueError("the folder has no files")
    base = a.folder.rstrip("/").removeprefix("file:").rstrip("/") + "/"
    files = found.select(F.substring_index(F.col("path"), base, -1).alias("name"), F.octet_length("content").cast("long").alias("size"), F.col("content").alias("data"))
    if wrong := batches.manifest_problems(files).limit(5).collect():
        raise ValueError("; ".join(f"{r.rule} {r.detail}".strip() for r in wrong))
    print(json.dumps({"sha256": sinks.pack(files, a.output)}))


def assets_install(spark: SparkSession, a: argparse.Namespace) -> None:
    print(json.dumps({"bundle": bundles.install(spark, a.bundle, a.root, sha256=a.sha256, size=a.size)}))


def assets_info(spark: SparkSession, a: argparse.Namespace) -> None:
    name, files = bundles.installed(spark, a.root)
    print(json.dumps({"bundle": name}))
    _show(files.select("name", "size", F.sha2("data", 256).alias("sha256")).orderBy("name"), a.limit)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="attesta")
    sub = top.add_subparsers(required=True)

    def add(name: str, run, *names: str, to=sub) -> argparse.ArgumentParser:
        p = to.add_parser(name)
        for n in names:
            p.add_argument(n)
        p.add_argument("--limit", type=int, default=1000)
        p.set_defaults(run=run)
        return p

    p = add("fetch", fetch, "base", "dataset", "output")
    p.add_argument("--region", default="jp")
    add("import", import_, "input", "output").add_argument("--catalogue")
    add("from-extraction", from_extraction, "input", "output")
    add("diff", diff, "before", "after")
    add("merge", merge, "base", "incoming", "output").add_argument("--allow-observed", action="store_true")
    p = add("export", export, "input", "output")
    p.add_argument("--base")
    p.add_argument("--allow-observed", action="store_true")
    p = add("rewards", calculate, "stages", "groups")
    p.add_argument("--ids", type=int, nargs="*")
    p.add_argument("--server", default="Jp", choices=("Jp", "Global", "Cn"))
    p.add_argument("--region", default="jp")
    p.add_argument("--condition", action="append", default=[], choices=("FirstClear", "ThreeStar"))
    nested = sub.add_parser("cache").add_subparsers(required=True)
    for what in ("info", "history", "versions", "due"):
        p = add(what, cache_log, "folder", to=nested)
        p.set_defaults(what=what)
        p.add_argument("--url")
        p.add_argument("--now", type=float)
    p = add("get", cache_get, "folder", "url", to=nested)
    p.add_argument("--kind", default="json", choices=("json", "image"))
    p.add_argument("--mode", choices=("auto", "manual", "offline", "refresh"))
    p.add_argument("--now", type=float)
    add("verify", cache_verify, "folder", to=nested)
    p = add("policy", cache_policy, "folder", to=nested)
    p.add_argument("--mode", choices=("auto", "manual", "offline"))
    for name in ("--json-ttl", "--image-ttl", "--pace"):
        p.add_argument(name, type=float)
    p = add("update", cache_update, "folder", to=nested)
    p.add_argument("--refresh", action="store_true")
    p.add_argument("--now", type=float)

    nested = sub.add_parser("students").add_subparsers(required=True)
    add("extract", extract, "input", "output", to=nested).add_argument("--corrections")
    add("inspect", inspect, "input", to=nested).add_argument("--page")
    add("doctor", doctor, "input", to=nested)
    p = add("export", export_extraction, "input", "output", to=nested)
    p.add_argument("--base")
    p.add_argument("--allow-observed", action="store_true")

    p = add("scan", scan, "input")
    p.add_argument("--expected")
    p.add_argument("--output")

    nested = sub.add_parser("assets").add_subparsers(required=True)
    add("pack", assets_pack, "folder", "output", to=nested)
    for to, name in ((nested, "install"), (sub, "setup")):
        p = add(name, assets_install, "bundle", "root", to=to)
        p.add_argument("--sha256")
        p.add_argument("--size", type=int)
    add("info", assets_info, "root", to=nested)
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        a.run(_session(), a)
    except (ValueError, FileExistsError, TimeoutError, PySparkException) as e:
        print(json.dumps({"error": str(e).splitlines()[0]}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
