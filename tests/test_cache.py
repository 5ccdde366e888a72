"""The cache's state machine with a fake clock and transport."""

import os
import shutil
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from attesta.sources.cached import Answer, Cache, CacheMiss, Held

URL = "https://h.example/data.json"


class Fake:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def __call__(self, url, etag, modified):
        self.calls.append((url, etag))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def test_life_of_a_resource(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "c"))
    t = Fake(Answer(200, b'{"a":1}', etag="x"), Answer(304), Answer(200, b'{"a":2}'), TimeoutError("slow"), Answer(200, b"not json"))
    get = lambda now, **k: c.get(URL, t, now, ttl=10, **k)
    assert get(0).status == "downloaded"
    assert get(1).status == "hit"
    assert get(11).status == "not-modified" and t.calls[-1] == (URL, "x")
    assert get(12).status == "hit"
    assert get(30).body == b'{"a":2}'
    assert get(50).status == "stale-error"
    assert get(51).status == "stale-backoff"
    assert get(52, mode="offline").status == "offline-hit"
    assert get(2000).status == "stale-error"  # an invalid body keeps the old one
    assert get(3000, mode="manual").body == b'{"a":2}'
    assert len(t.calls) == 5
    assert {r.status: r["count"] for r in c.events().groupBy("status").count().collect()} == {"downloaded": 2, "not-modified": 1, "failed": 2}
    assert c.damaged().count() == 0


def test_misses_seeds_and_blocks(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "c"))
    with pytest.raises(CacheMiss):
        c.get(URL, Fake(), 0, mode="offline")
    assert c.get(URL, Fake(), 0, seed=(b'{"s":1}', 0.0)).status == "adopted"
    assert c.get("https://h.example/b.json", Fake(Answer(200, b'{"s":1}')), 1).status == "downloaded"
    assert c._read("bodies", "sha256 string, body binary").count() == 1  # by content
    with pytest.raises(CacheMiss):
        c.get("https://h.example/c.json", Fake(Answer(503, retry_after=900.0)), 2)
    with pytest.raises(CacheMiss):  # the whole host waits
        c.get("https://h.example/d.json", Fake(), 500)
    with pytest.raises(ValueError):
        c.get("https://u:p@h.example/", Fake(), 0)


def test_update_takes_what_is_due(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "c"))
    day = 86400.0
    c.get("https://h.example/a.json", Fake(Answer(200, b"{}")), 0)
    c.get("https://h.example/b.json", Fake(Answer(200, b"{}")), 6 * day)
    assert c.update(Fake(Answer(200, b'{"n":1}')), 8 * day) == {"downloaded": 1}
    waits = []
    assert c.update(Fake(Answer(304), Answer(200, b"{}")), 8 * day + 1, refresh=True, sleep=waits.append) == {"stale-error": 1, "unchanged": 1}
    assert waits == [0.5]  # two requests at one time


def test_hosts_are_compared_whole(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "c"))
    with pytest.raises(CacheMiss):
        c.get("https://a.co/x.json", Fake(Answer(429, retry_after=900.0)), 0)
    assert c.get("https://a.company/x.json", Fake(Answer(200, b"{}")), 10).status == "downloaded"
    with pytest.raises(CacheMiss):
        c.get("https://a.co:8443/y.json", Fake(), 20)


def test_requests_keep_their_distance(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "c"))
    waits = []
    for i, now in enumerate((10.0, 10.25, 60.0)):
        c.get(f"https://h.example/{i}.json", Fake(Answer(200, b"{}")), now, sleep=waits.append)
    assert waits == [0.25]
    assert sorted(r.at for r in c.events().collect()) == [10.0, 10.5, 60.0]


def test_callers_take_turns(spark, tmp_path):
    """Many callers at once: one download, unique ids, and the lock of one that died is taken over."""
    c = Cache(spark, str(tmp_path / "c"))
    calls = []

    def slow(url, etag, modified):
        calls.append(url)
        time.sleep(0.2)
        return Answer(200, b'{"a":1}')

    start = time.time()
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda _: c.get(URL, slow, start, clock=time.time).body, range(4)))
    assert found == [b'{"a":1}'] * 4 and calls == [URL]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: c.get(f"https://h.example/{i}.json", Fake(Answer(200, b"{}")), time.time(), sleep=lambda _: None), range(3)))
    ids = [r.id for r in c.events().collect()]
    assert sorted(ids) == [0, 1, 2, 3]
    lock = tmp_path / "c" / "lock"
    lock.write_text("")
    os.utime(lock, (0, 0))
    assert c.get(URL, Fake(), start, mode="offline").status == "offline-hit" and not lock.exists()


def test_tables_are_kept_until_something_happens(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "c"))
    made = []

    def make():
        made.append(1)
        return c.events().groupBy("status").count()

    held = Held(c, make)
    assert held.get().count() == held.get().count() == 0 and len(made) == 1
    c.get(URL, Fake(Answer(200, b"{}")), 0)
    assert held.get().count() == 1 and len(made) == 2 and c.generation() == 0


def test_policy_and_verification(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "c"))
    assert c.configure(mode="manual", json_ttl=120.0).json_ttl == 120
    with pytest.raises(ValueError):
        c.configure(json_ttl=-1.0)
    assert Cache(spark, str(tmp_path / "c")).policy().mode == "manual"
    assert c.get(URL, Fake(Answer(200, b"{}")), 0).status == "downloaded"
    assert c.get(URL, Fake(), 10**9).status == "hit"
    c.configure(mode="auto")
    assert c.get(URL, Fake(Answer(200, b'{"b":1}')), 121).status == "downloaded"
    assert c.verify() == {"ok": True, "bodies": 1, "missing": 0, "damaged": 0}
    shutil.rmtree(tmp_path / "c" / "bodies")
    assert c.verify() == {"ok": False, "bodies": 1, "missing": 1, "damaged": 0}
