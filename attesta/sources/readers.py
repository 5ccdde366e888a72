"""Readers: catalogues, account snapshots, corrections, images and manifests as DataFrames."""

from __future__ import annotations

import io
import json
import stat
import urllib.request
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from attesta.domain import SOURCE
from attesta.functions.text import padded
from attesta.operators.batches import manifest_problems, numbered
from attesta.operators.snapshots import Snapshot

# ---- fixed values --------------------------------------------------------------------------------------------------
DATASETS = ("students", "groups", "stages", "items", "equipment", "furniture")
REGIONS = ("jp", "global", "cn", "en")
MAPPING_PARTS = ("class_to_name", "name_to_class", "num_classes", "categories")
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp")
# --------------------------------------------------------------------------------------------------------------------


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, without a byte order mark."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\\A\ufeff", "").alias("text"))


def catalogue(spark: SparkSession, path: str, dataset: str, region: str) -> DataFrame:
    """(dataset, region, ordinal, id, name, entry, sha256): a JSON object from ids to entries, which stay as VARIANT; ``ordinal`` is
    an entry's place in the file, from 0."""
    if dataset not in DATASETS or region not in REGIONS:
        raise ValueError(f"unknown catalogue: {dataset}, {region}")
    return _entries(_whole(spark, path).select("text"), dataset, region)


def _entries(files: DataFrame, dataset: str, region: str) -> DataFrame:
    files = files.select("text", F.sha2("text", 256).alias("sha256"))
    files.select("sha256", F.parse_json("text").alias("data")).createOrReplaceTempView("attesta_catalogue")
    rows = files.sparkSession.sql("SELECT f.sha256, e.key, e.value AS entry FROM attesta_catalogue f, LATERAL variant_explode(f.data) e")
    order = files.select("sha256", F.posexplode(F.json_object_keys("text")).alias("ordinal", "key"))  # a VARIANT's own keys are sorted
    return rows.join(order, ["sha256", "key"]).select(F.lit(dataset).alias("dataset"), F.lit(region).alias("region"), "ordinal", F.col("key").try_cast("long").alias("id"), F.expr("try_variant_get(entry, '$.Name', 'string')").alias("name"), "entry", "sha256")


def typed(catalogue_: DataFrame, schema: T.StructType | str) -> DataFrame:
    """A catalogue's entries as columns of ``schema`` after their id; an entry's own Id is the same and left out."""
    rows = catalogue_.select("id", F.from_json(F.to_json("entry"), schema).alias("e"))
    return rows.select("id", *(F.col("e")[c].alias(c) for c in rows.schema["e"].dataType.names if c.lower() != "id"))


def account(spark: SparkSession, path: str) -> Snapshot:
    """The snapshot in an account file: {"students": [{key, student_id, name, identity_status, fields, sources, extensions}]}."""
    entry = T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("student_id", T.LongType()),
            T.StructField("name", T.StringType()),
            T.StructField("identity_status", T.StringType()),
            T.StructField("fields", T.MapType(T.StringType(), T.StructType([T.StructField("value", T.LongType()), T.StructField("status", T.StringType()), T.StructField("sources", T.ArrayType(SOURCE))]))),
            T.StructField("sources", T.ArrayType(SOURCE)),
            T.StructField("extensions", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    rows = _whole(spark, path).select(F.explode(F.from_json("text", T.StructType([T.StructField("students", T.ArrayType(entry))]))["students"]).alias("s"))
    entities = rows.select("s.key", F.col("s.student_id").alias("entity_id"), "s.name", F.coalesce("s.identity_status", F.lit("unknown")).alias("identity_status"), "s.extensions", "s.sources")
    readings = rows.select("s.key", F.col("s.student_id").alias("entity_id"), F.explode("s.fields").alias("field", "r")).select("key", "entity_id", "field", "r.value", F.coalesce("r.status", F.lit("unknown")).alias("status"), "r.sources")
    return Snapshot(entities, readings)


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """(key, field, value) from a corrections file; another version of the format stops the query."""
    schema = "schema_version int, students map<string, struct<student_id: long, fields: map<string, long>>>"
    rows = _whole(spark, path).select(F.from_json("text", schema).alias("c"))
    checked = F.when(F.col("c.schema_version") == 1, F.col("c.students")).otherwise(F.raise_error(F.lit("unsupported corrections format")).cast("map<string, struct<student_id: bigint, fields: map<string, bigint>>>"))
    return rows.select(F.explode(checked).alias("key", "change")).select("key", F.explode("change.fields").alias("field", "value"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(ordinal, name, path, data, sha256): images of a folder in natural order of their names."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join([*IMAGES, *(x.upper() for x in IMAGES)]) + "}").load(folder)
    return numbered(found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("content").alias("data"), F.sha2("content", 256).alias("sha256")))


def listed_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ordinal, name, path, data, sha256) of image files in the order in which they are listed; a missing one stops the query."""
    wanted = spark.createDataFrame(list(enumerate(paths)), "ordinal long, wanted string")
    found = spark.read.format("binaryFile").load(list(dict.fromkeys(paths)))
    plain = lambda x: F.regexp_replace(x, "^file:/+", "/")
    joined = wanted.join(found.select(plain(F.col("path")).alias("_p"), "path", "content"), plain(F.col("wanted")) == F.col("_p"), "left")
    data = F.coalesce("content", F.raise_error(F.concat(F.lit("no such image: "), "wanted")).cast("binary"))
    return joined.select("ordinal", F.element_at(F.split("wanted", "/"), -1).alias("name"), "path", data.alias("data"), F.sha2(data, 256).alias("sha256"))


def given_images(spark: SparkSession, images_: list[bytes]) -> DataFrame:
    """(ordinal, name, path, data, sha256) of images that the caller holds."""
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(images_)], "ordinal long, data binary")
    return rows.select("ordinal", padded("image_", F.col("ordinal"), 6).alias("name"), F.lit(None).cast("string").alias("path"), "data", F.sha2("data", 256).alias("sha256"))


def resolved(spark: SparkSession, source: str | bytes | list[str] | list[bytes]) -> DataFrame:
    """One ordered batch of images from a folder, an image, a manifest, a list of images, or their bytes.  Frames of a video need a
    decoder and are no source here."""
    if isinstance(source, bytes):
        return given_images(spark, [source])
    if isinstance(source, list):
        return given_images(spark, source) if source and isinstance(source[0], bytes) else listed_images(spark, source)
    if source.endswith(".json"):
        folder, named = source.rpartition("/")[0], manifest(spark, source)
        return listed_images(spark, [f"{folder}/{r.name}" for r in named.orderBy("ordinal").collect()]).join(named.select("ordinal", "timestamp"), "ordinal")  # one manifest's files
    return listed_images(spark, [source]) if source.lower().endswith(tuple(f".{x}" for x in IMAGES)) else images(spark, source)


def class_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(name, class) of a class mapping; one that lacks a part stops the query."""
    files = _whole(spark, path)
    missing = F.array_except(F.array(*map(F.lit, MAPPING_PARTS)), F.json_object_keys("text"))
    body = F.when(F.size(missing) == 0, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("missing parts: "), F.array_join(missing, ", "))))
    entries = F.from_json(body, "name_to_class map<string, string>")["name_to_class"]
    return files.select(F.explode(entries).alias("name", "class")).select("name", F.col("class").cast("long").alias("class"))


def labelled_templates(spark: SparkSession, labels: str, folder: str) -> DataFrame:
    """(name, label, data): the templates of a label file {name: label} with their images; one without an image has null data."""
    entries = _whole(spark, labels).select(F.explode(F.from_json("text", "map<string, string>")).alias("name", "label"))
    return entries.join(images(spark, folder).select("name", "data"), "name", "left")


def bundle(spark: SparkSession, path: str, *, sha256: str | None = None, size: int | None = None, required: tuple[str, ...] = (), most_files: int = 4096, most_bytes: int = 512 << 20) -> DataFrame:
    """(name, size, data) of the members of a ZIP bundle of a pinned hash and size, if given.

    Nothing of a bundle is read before its list of members has passed the rules of ``batches.manifest_problems``; a bundle that
    breaks one stops the query.  Bundles are small packages: one is read in one task."""

    def members(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for raw in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    found = [m for m in archive.infolist()]
                    plain = [not m.is_dir() and not stat.S_ISLNK(m.external_attr >> 16) and m.orig_filename == m.filename for m in found]
                    yield pa.RecordBatch.from_arrays([pa.array([m.filename for m in found], pa.string()), pa.array([m.file_size for m in found], pa.int64()), pa.array(plain, pa.bool_())], ["name", "size", "plain"])

    def bodies(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for raw in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    for m in archive.infolist():
                        with archive.open(m) as f:
                            data = f.read(m.file_size + 1)
                        if len(data) != m.file_size:
                            raise ValueError(f"{m.filename} is larger than it says")
                        yield pa.RecordBatch.from_arrays([pa.array([m.filename], pa.string()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["name", "size", "data"])

    file = spark.read.format("binaryFile").load(path).select("content")
    digest = file.select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size")).first()
    if (sha256 and digest.sha256 != sha256) or (size is not None and digest.size != size):
        raise ValueError("the bundle is not the pinned one")
    listed = file.mapInArrow(members, "name string, size long, plain boolean")
    problems = [*(f"no plain file: {r.name}" for r in listed.where("not plain").limit(5).collect()), *(f"{r.rule} {r.detail}".strip() for r in manifest_problems(listed, required, most_files, most_bytes).limit(5).collect())]
    if problems:
        raise ValueError("; ".join(problems))
    return file.mapInArrow(bodies, "name string, size long, data binary")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, timestamp) of a manifest {"images": [{"path", "timestamp"}]}; timestamps may be absent."""
    rows = _whole(spark, path).select(F.posexplode(F.from_json("text", "images array<struct<path: string, timestamp: double>>")["images"]).alias("ordinal", "i"))
    return rows.select("ordinal", F.col("i.path").alias("name"), "i.timestamp")


def annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


class _Part(InputPartition):
    def __init__(self, url: str) -> None:
        super().__init__(url)
        self.url = url


class _HttpReader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float) -> None:
        self.urls, self.timeout = urls, timeout

    def partitions(self) -> list[InputPartition]:
        return [_Part(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with urllib.request.urlopen(partition.url, timeout=self.timeout) as answer:
            body = answer.read((64 << 20) + 1)
        if not body or len(body) > 64 << 20:
            raise ValueError("the payload is empty or too large")
        json.loads(body)
        yield pa.RecordBatch.from_pydict({"url": [partition.url], "text": [body.decode("utf-8-sig")]})


class HttpCatalogue(DataSource):
    """``spark.read.format("attesta-http").option("urls", "https://a/x.json https://b/y.json")``: (url, text), one task a url."""

    @classmethod
    def name(cls) -> str:
        return "attesta-http"

    def schema(self) -> str:
        return "url string, text string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        urls = self.options.get("urls", "").split()
        if not urls or any(not u.startswith(("http://", "https://")) for u in urls):
            raise ValueError("urls of http or https are required")
        return _HttpReader(urls, float(self.options.get("timeout", "30")))


def catalogue_url(base: str, dataset: str, region: str) -> str:
    """Groups are the same in all regions."""
    return f"{base.rstrip('/')}/data/{dataset}.min.json" if dataset == "groups" else f"{base.rstrip('/')}/data/{region}/{dataset}.min.json"


def fetched_catalogue(spark: SparkSession, base: str, dataset: str, region: str) -> DataFrame:
    spark.dataSource.register(HttpCatalogue)
    raw = spark.read.format("attesta-http").option("urls", catalogue_url(base, dataset, region)).load()
    return _entries(raw.select("text"), dataset, region)
