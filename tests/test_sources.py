"""Readers, codecs, sinks and streams."""

import base64
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from attesta.domain import WIRE_KEYS
from attesta.operators import cachelog
from attesta.sources import codec, readers, sinks
from attesta.streaming import cache_events


def wire(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, text string")


def b64(x):
    return base64.b64encode(json.dumps(x).encode()).decode()


def test_wire_to_snapshot(spark):
    s = codec.from_wire(wire(spark, " " + b64({"10001": {"l": 90, "lock": True, "extra": [1]}, "7": {}}) + "\n"))
    assert [(r.entity_id, r.field, r.value, r.status) for r in s.readings.collect()] == [(10001, "level", 90, "imported")]
    e = {r.entity_id: r.extensions for r in s.entities.collect()}
    assert e[10001] == {"lock": "true", "extra": "[1]"}
    assert set(e) == {7, 10001}


@pytest.mark.parametrize("bad", ["%%%%", b64({"1": {"l": 1}}) + "\n=", b64([]), b64({"1": {"l": True}}), b64({"1": {"s": 101}}), b64({"1": {"l": 5.0}}), b64({"x": {"l": 5}})])
def test_bad_wire(spark, bad):
    assert codec.problems(wire(spark, bad)).count() >= 1


def test_good_wire(spark):
    assert codec.problems(wire(spark, b64({"1": {k: 1 for k in WIRE_KEYS.values()}}))).count() == 0


def test_round_trip(spark):
    data = {str(i): {"l": i % 100, "lock": True, "note": 'é "x"'} for i in range(1, 60)}
    rows = codec.records(wire(spark, b64(data))).select(F.col("entity").cast("long").alias("entity_id"), "wire_key", "text")
    out = codec.to_wire(rows).first().text
    assert "\n" not in out
    assert json.loads(base64.b64decode(out)) == data


def test_files(spark, tmp_path):
    f = tmp_path / "students.json"
    f.write_text("﻿" + json.dumps({"1": {"Name": "A", "Id": 1}, "2": {"Id": 2}}), encoding="utf-8")
    c = readers.catalogue(spark, str(f), "students", "jp")
    assert sorted((r.id, r.name) for r in c.collect()) == [(1, "A"), (2, None)]
    a = tmp_path / "account.json"
    a.write_text(json.dumps({"students": [{"key": "k", "student_id": 5, "identity_status": "confirmed", "fields": {"level": {"value": 9, "status": "confirmed"}}}]}))
    s = readers.account(spark, str(a))
    assert [(r.entity_id, r.field, r.value) for r in s.readings.collect()] == [(5, "level", 9)]
    p = tmp_path / "corrections.json"
    p.write_text(json.dumps({"schema_version": 1, "students": {"k": {"fields": {"level": None, "gear": 2}}}}))
    assert sorted((r.field, r.value) for r in readers.corrections(spark, str(p)).collect()) == [("gear", 2), ("level", None)]
    for n in ("image10.png", "image2.PNG", "notes.txt"):
        (tmp_path / "img").mkdir(exist_ok=True)
        (tmp_path / "img" / n).write_bytes(n.encode())
    assert [r.name for r in readers.images(spark, str(tmp_path / "img")).orderBy("ordinal").collect()] == ["image2.PNG", "image10.png"]


def test_http(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps({"3": {"Name": self.path}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = readers.fetched_catalogue(spark, f"http://127.0.0.1:{server.server_port}", "items", "global").first()
    finally:
        server.shutdown()
    assert (got.id, got.name) == (3, "/data/global/items.min.json")


def test_nothing_is_overwritten(spark, tmp_path):
    df, a, b = spark.range(3), str(tmp_path / "a"), str(tmp_path / "b")
    sinks.write_all({a: df})
    with pytest.raises(FileExistsError):
        sinks.write_all({b: df, a: df})
    assert not (tmp_path / "b").exists()
    side = sinks.write_with_report(df, b, {"n": 3})
    assert json.loads(spark.read.text(side).first().value) == {"n": 3}
    assert sinks.numbered_output(spark, str(tmp_path), "a") == f"{a}-2"
    assert sinks.numbered_output(spark, str(tmp_path), "a", resume=True) == a
    sinks.write_blobs(spark.createDataFrame([("aa1", "x"), ("aa1", "x"), ("bb2", "y")], "sha256 string, body string"), str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2


SCHEMA = "id long, url string, kind string, at double, status string, sha256 string, size long, http_status int, retry_after double"


def test_stream_gives_what_replay_gives(spark, tmp_path):
    rows = [(i, f"https://h.example/{i % 3}", "json", float(i * 10), ["downloaded", "failed", "not-modified", "failed", "failed"][i % 5], f"b{i % 4}" if i % 5 in (0, 2) else None, 1, None, None) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = cache_events.versions(stream).writeStream.outputMode("complete").format("memory").queryName("attesta_versions").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("attesta_versions").collect())
    log = spark.createDataFrame(rows, SCHEMA)
    assert got == sorted(tuple(r) for r in cachelog.versions(log).select("url", "sha256", "first_seen", "last_seen").collect())
    q = cache_events.entries(stream).writeStream.outputMode("update").format("memory").queryName("attesta_entries").start()
    q.processAllAvailable()
    q.stop()
    last = {r.url: (r.sha256, r.failures, r.retry_at) for r in spark.table("attesta_entries").orderBy("last_id").collect()}
    assert last == {r.url: (r.sha256, r.failures, r.retry_at) for r in cachelog.entries(log).collect()}


def test_images_from_anywhere(spark, tmp_path):
    """A folder, a list, a manifest, one file, or bytes: the same ordered batch."""
    names = ["image2.png", "image10.png", "image1.png"]
    for n in names:
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "note.txt").write_text("no image")
    got = lambda source: [(r.ordinal, r.name, bytes(r.data)) for r in readers.resolved(spark, source).orderBy("ordinal").collect()]
    natural = ["image1.png", "image2.png", "image10.png"]
    assert got(str(tmp_path)) == [(i, n, n.encode()) for i, n in enumerate(natural)]
    assert got([str(tmp_path / n) for n in [*names, names[0]]]) == [(i, n, n.encode()) for i, n in enumerate([*names, names[0]])]
    assert got([b"x", b"y"]) == [(0, "image_000000", b"x"), (1, "image_000001", b"y")] and got(b"x") == [(0, "image_000000", b"x")]
    assert got(str(tmp_path / names[1])) == [(0, names[1], names[1].encode())]
    (tmp_path / "m.json").write_text(json.dumps({"images": [{"path": n, "timestamp": i * 0.5} for i, n in enumerate(names)]}))
    assert got(str(tmp_path / "m.json")) == [(i, n, n.encode()) for i, n in enumerate(names)]
    with pytest.raises(Exception, match="no such image|PATH_NOT_FOUND"):
        got([str(tmp_path / names[0]), str(tmp_path / "gone.png")])


def test_class_mappings_and_templates(spark, tmp_path):
    whole = {"class_to_name": {"0": "a", "1": "b"}, "name_to_class": {"a": 0, "b": 1}, "num_classes": 2, "categories": ["x"]}
    (tmp_path / "c.json").write_text(json.dumps(whole))
    assert sorted(map(tuple, readers.class_mapping(spark, str(tmp_path / "c.json")).collect())) == [("a", 0), ("b", 1)]
    (tmp_path / "d.json").write_text(json.dumps({k: v for k, v in whole.items() if k != "categories"}))
    with pytest.raises(Exception, match="missing parts: categories"):
        readers.class_mapping(spark, str(tmp_path / "d.json")).collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.png").write_bytes(b"A")
    (tmp_path / "l.json").write_text(json.dumps({"a.png": "3", "b.png": "7"}))
    found = readers.labelled_templates(spark, str(tmp_path / "l.json"), str(tmp_path / "t")).collect()
    assert sorted((r.name, r.label, r.data and bytes(r.data)) for r in found) == [("a.png", "3", b"A"), ("b.png", "7", None)]
