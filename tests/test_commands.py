"""The command line, end to end."""

import base64
import hashlib
import json
import stat
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from attesta.__main__ import main
from attesta.sources import commits
from attesta.domain import WIRE_KEYS

WHOLE = {k: 1 for k in WIRE_KEYS.values()}


def wire(path, data):
    path.write_text(base64.b64encode(json.dumps(data).encode()).decode())
    return str(path)


def test_import_merge_diff_export(spark, tmp_path, capsys):
    a, b = wire(tmp_path / "a.txt", {"10001": {**WHOLE, "lock": True}, "99": {"sentinel": "kept"}}), wire(tmp_path / "b.txt", {"10001": {"l": 90}, "5": {"l": 3}})
    one, two, out = (str(tmp_path / x) for x in ("one", "two", "out"))
    assert main(["import", a, one]) == main(["import", b, two]) == 0
    assert main(["import", b, two]) == 1  # never overwrites
    assert main(["merge", one, two, out]) == 0
    readings = commits.read_output(spark, str(out), "readings")
    assert readings.where("entity_id = 10001 and field = 'level'").first().value == 90
    capsys.readouterr()
    assert main(["diff", one, two]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {(x["entity_id"], x["side"]) for x in lines if x["part"] == "ids"} == {(99, "missing"), (5, "added")}
    assert main(["export", out, str(tmp_path / "wire"), "--base", a]) == 0
    text = spark.read.text(str(tmp_path / "wire")).first().value
    got = json.loads(base64.b64decode(text))
    assert got["10001"]["l"] == 90 and got["10001"]["lock"] is True and got["99"] == {"sentinel": "kept"} and "5" not in got
    report = {r.entity_id: (r.outcome, len(r.missing)) for r in spark.read.json(str(tmp_path / "wire.report")).collect()}
    assert report[10001] == ("updated", 0) and report[5] == ("incomplete record", 15)


@pytest.mark.parametrize("bad", ["bad", base64.b64encode(b"[]").decode()])
def test_bad_input_is_refused(spark, tmp_path, bad):
    (tmp_path / "x.txt").write_text(bad)
    assert main(["import", str(tmp_path / "x.txt"), str(tmp_path / "o")]) == 1
    assert not (tmp_path / "o").exists()


def test_rewards(spark, tmp_path, capsys):
    base = {"EntryCost": [], "StarCondition": [1, 2], "Terrain": "Street", "Level": 1, "ArmorTypes": [], "Formations": []}
    stages = {
        "1": {**base, "Id": 1, "Category": "Bounty", "Type": "ChaserA", "Stage": 1, "Rewards": [{"Type": "Item", "Id": 5, "Amount": 2}], "ServerData": {"Cn": {"Rewards": []}, "Global": {"Formations": []}}},
        "2": {**base, "Id": 2, "Category": "WeekDungeon", "Type": "Blood", "Stage": 1, "Rewards": [{"Type": "GachaGroup", "Id": 9, "AmountMin": 1, "AmountMax": 3}]},
    }
    item = lambda i: {"Type": "Item", "Id": i, "Chance": 0.5, "AmountMin": 1, "AmountMax": 1}
    (tmp_path / "stages.json").write_text(json.dumps(stages))
    (tmp_path / "groups.json").write_text(json.dumps({"9": {"Items": [item(50)], "ItemsGlobal": [item(51)], "ItemsCn": []}}))

    def run(*more):
        capsys.readouterr()
        assert main(["rewards", str(tmp_path / "stages.json"), str(tmp_path / "groups.json"), *more]) == 0
        return [(x["stage_id"], x["item_id"], x["expected"]) for x in map(json.loads, capsys.readouterr().out.splitlines())]

    assert run() == [(1, 5, 2.0), (2, 50, 1.0)]
    assert run("--server", "Global", "--ids", "2", "1", "2") == [(2, 51, 1.0), (1, 5, 2.0), (2, 51, 1.0)]
    assert run("--server", "Cn") == [(2, 50, 1.0)]
    assert main(["rewards", str(tmp_path / "stages.json"), str(tmp_path / "groups.json"), "--ids", "0"]) == 1


def test_names_of_the_package():
    import attesta

    assert all(getattr(attesta, name) is not None for name in attesta.__all__)
    with pytest.raises(AttributeError):
        attesta.nothing  # noqa: B018


def said(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_extraction_to_export(spark, tmp_path, capsys):
    fields = ["level", "star", "bond"]
    rows = [(f"v{v}", o, 10001, "A", [f"s{o}"], f, 3 + (f == "level" and o == 9), "observed", [f"i{o}"], "blurred" if o == 4 else None) for v in (1, 2) for o in (1, 2, 4) for f in fields]
    rows += [("v3", 7, None, "", ["s7"], "level", 5, "observed", ["i7"], None), ("v4", 8, 10002, "B", ["s8"], "level", 9, "observed", ["i8"], "not_entity_screen")]
    spark.createDataFrame(rows, "key string, observation long, entity_id long, name string, screenshots array<string>, field string, value long, status string, images array<string>, rejection string").write.parquet(str(tmp_path / "obs"))
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 1, "students": {"entity_10001": {"student_id": 10001, "fields": {"bond": 7}}}}))
    out = str(tmp_path / "out")
    assert main(["students", "extract", str(tmp_path / "obs"), out, "--corrections", str(tmp_path / "c.json")]) == 0
    assert said(capsys) == [{"entities": 2, "identified": 1}]
    assert {r.key for r in commits.read_output(spark, str(out), "observations").where("rejection = 'not_entity_screen'").collect()} == {"v4"}
    assert main(["students", "inspect", out, "--page", str(tmp_path / "page")]) == 0
    shown = said(capsys)
    assert shown[0] == {"entities": 2, "needing_review": 1, "open_fields": 1}
    final = {x["key"]: x["fields"] for x in shown if "fields" in x}
    assert final["entity_10001"]["level"] == {"value": 3, "status": "confirmed"} and final["entity_10001"]["bond"] == {"value": 7, "status": "corrected"}
    page = "".join(r.value for r in spark.read.text(str(tmp_path / "page")).collect())
    assert "<td>entity_10001</td>" in page and "<td>[&quot;i1&quot;,&quot;i2&quot;" in page
    assert main(["students", "doctor", out]) == 0 and said(capsys)[0]["ok"]
    base = wire(tmp_path / "b.txt", {"10001": {**WHOLE, "lock": False}})
    assert main(["students", "export", out, str(tmp_path / "wire"), "--base", base]) == 0
    got = json.loads(base64.b64decode(spark.read.text(str(tmp_path / "wire")).first().value))
    assert got["10001"]["l"] == 3 and got["10001"]["b"] == 7
    assert main(["students", "extract", str(tmp_path / "obs"), out]) == 1  # never overwrites


def test_scan(spark, tmp_path, capsys):
    cells = [(0, 0, "Hat", 3), (0, 1, "Hat", None), (1, 0, "Bag", 2)]
    spark.createDataFrame(cells, "row int, col int, category string, quantity int").write.parquet(str(tmp_path / "cells"))
    spark.createDataFrame([(0, 0, 3), (1, 0, 5), (2, 2, 1)], "row int, col int, quantity int").write.parquet(str(tmp_path / "want"))
    assert main(["scan", str(tmp_path / "cells"), "--expected", str(tmp_path / "want"), "--output", str(tmp_path / "kept")]) == 0
    assert said(capsys) == [{"category": "Bag", "cells": 1, "known": 1, "quantity": 2}, {"category": "Hat", "cells": 2, "known": 1, "quantity": 3}, {"detected": 2, "missing": 1, "extra": 1, "correct": 1, "wrong": 1}]


def test_cache_commands(spark, tmp_path, capsys):
    hits = []

    class Origin(BaseHTTPRequestHandler):
        def do_GET(self):
            hits.append(self.path)
            if self.headers.get("If-None-Match") == '"e"':
                self.send_response(304)
                self.end_headers()
                return
            self.send_response(200 if self.path == "/a.json" else 404)
            self.send_header("ETag", '"e"')
            self.end_headers()
            if self.path == "/a.json":
                self.wfile.write(b'{"a": 1}')

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Origin)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    folder, url = str(tmp_path / "cache"), f"http://127.0.0.1:{server.server_port}"
    try:
        assert main(["cache", "get", folder, f"{url}/a.json", "--now", "1000"]) == 0
        assert main(["cache", "get", folder, f"{url}/a.json", "--now", "1001"]) == 0
        assert [x["status"] for x in said(capsys)] == ["downloaded", "hit"]
        assert main(["cache", "get", folder, f"{url}/b.json", "--now", "1002"]) == 1
        assert main(["cache", "verify", folder]) == 0 and said(capsys)[0]["ok"]
        assert main(["cache", "policy", folder, "--json-ttl", "120"]) == 0 and said(capsys)[0]["json_ttl"] == 120
        assert main(["cache", "policy", folder, "--json-ttl", "-1"]) == 1
        assert main(["cache", "update", folder, "--now", "700000"]) == 1  # b.json is still gone
        assert said(capsys)[0] == {"not-modified": 1, "failed": 1}
        assert main(["cache", "info", folder]) == main(["cache", "history", folder]) == main(["cache", "versions", folder]) == main(["cache", "due", folder, "--now", "700001"]) == 0
        assert said(capsys)[0]["events"] == 4
        assert hits == ["/a.json", "/b.json", "/a.json", "/b.json"]
    finally:
        server.shutdown()
        server.server_close()


def test_bundles(spark, tmp_path, capsys):
    source = tmp_path / "files"
    (source / "sub").mkdir(parents=True)
    (source / "a.json").write_text("{}")
    (source / "sub" / "b.bin").write_bytes(bytes(range(256)))
    zip_, root = str(tmp_path / "x.zip"), str(tmp_path / "root")
    assert main(["assets", "info", root]) == 1
    assert main(["assets", "pack", str(source), zip_]) == 0
    digest = said(capsys)[0]["sha256"]
    assert main(["assets", "pack", str(source), zip_]) == 1  # never overwrites
    assert main(["assets", "install", zip_, root, "--sha256", "0" * 64]) == 1
    assert main(["assets", "install", zip_, root, "--sha256", digest]) == main(["setup", zip_, root]) == 0
    names = [x["bundle"] for x in said(capsys)]
    assert names[0] == names[1]
    assert main(["assets", "info", root]) == 0
    shown = said(capsys)
    assert shown[0] == {"bundle": names[0]} and [(x["name"], x["size"]) for x in shown[1:]] == [("a.json", 2), ("sub/b.bin", 256)]


@pytest.mark.parametrize("bad", ["../up", "/root", "a//b", "CON", "link", "twice", "wrong"])
def test_unsafe_bundles_are_refused(spark, tmp_path, bad):
    path = tmp_path / "x.zip"
    listed = {"a": {"sha256": "0" * 64 if bad == "wrong" else hashlib.sha256(b"x").hexdigest(), "size": 1}}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("manifest.json", json.dumps({"schema_version": 1, "files": listed}))
        z.writestr("a", b"x")
        if bad == "link":
            info = zipfile.ZipInfo("l")
            info.external_attr = (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, b"a")
        elif bad == "twice":
            z.writestr("A", b"x")
        elif bad != "wrong":
            z.writestr(bad, b"x")
    assert main(["assets", "install", str(path), str(tmp_path / "root")]) == 1
    assert not (tmp_path / "root" / "current.json").exists()
