"""A verified cache of remote resources over the event log of ``attesta.operators.cachelog``.

The log is a Parquet table that only grows; bodies are stored by content.  ``Cache.get`` replays one url's events, decides
what to do, and appends what happened, while it holds the cache's lock: callers of any process take turns, so ids are unique,
a resource that many want at once is downloaded once, and requests keep their distance.  The lock is a file that only one can
create (on file systems where creation is atomic); one that is older than ``LEASE`` seconds belonged to a caller that died.
Time, waiting and transport are arguments, so a log can be replayed and tested.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import normalized_url
from attesta.operators import cachelog
from attesta.sources import sinks

EVENTS = "id long, url string, kind string, at double, status string, sha256 string, size long, error string, http_status int, retry_after double, etag string, modified string"
BODIES = "sha256 string, body binary"


class Answer(NamedTuple):
    """What a transport returns: ``status`` 200 with a body, 304, or an error; Retry-After in seconds."""

    status: int
    body: bytes = b""
    etag: str | None = None
    modified: str | None = None
    retry_after: float | None = None


class Result(NamedTuple):
    status: str  # hit, offline-hit, downloaded, unchanged, not-modified, adopted, stale-error or stale-backoff
    body: bytes


class Held:
    """A table that is made from a cache and kept in Spark's memory until the cache has new events."""

    def __init__(self, cache: Cache, make: Callable[[], DataFrame]) -> None:
        self.cache, self.make = cache, make
        self.generation: int | None = None
        self.table: DataFrame | None = None

    def get(self) -> DataFrame:
        now = self.cache.generation()
        if self.table is None or now != self.generation:
            if self.table is not None:
                self.table.unpersist()
            self.table, self.generation = self.make().cache(), now
        return self.table


class CacheMiss(RuntimeError):
    """There is no body and none can be had."""


class Policy(NamedTuple):
    """How a cache asks by default; kept beside its log."""

    mode: str = "auto"
    json_ttl: float = cachelog.TTL_SECONDS["json"]
    image_ttl: float = cachelog.TTL_SECONDS["image"]
    pace: float = cachelog.PACE  # least seconds between two requests


#: Seconds after which a lock counts as abandoned, and between two attempts to get it.
LEASE, ATTEMPT = 120.0, 0.05
REQUESTED = ("downloaded", "unchanged", "not-modified", "failed")

Transport = Callable[[str, str | None, str | None], Answer]


def checked(kind: str, body: bytes, most: int = 64 << 20) -> bytes:
    """``body`` if it can be of its kind."""
    if not body or len(body) > most:
        raise ValueError("the payload is empty or too large")
    if kind == "json" and not isinstance(json.loads(body), dict):
        raise ValueError("the payload is not a JSON object")
    if kind == "image" and not (body[:8] == b"\x89PNG\r\n\x1a\n" or body[:3] == b"\xff\xd8\xff" or (body[:4] == b"RIFF" and body[8:12] == b"WEBP")):
        raise ValueError("the payload is no image")
    return body


class Cache:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if sinks._exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._read("events", EVENTS)

    def generation(self) -> int:
        """A number that grows with every event; -1 before the first."""
        last = self.events().agg(F.max("id")).first()[0]
        return -1 if last is None else last

    def policy(self) -> Policy:
        path = f"{self.folder}/policy.json"
        return Policy(**json.loads(sinks.read_text(self.spark, path))) if sinks._exists(self.spark, path) else Policy()

    def configure(self, **changes: str | float) -> Policy:
        """Changes the policy; what isn't named stays."""
        new = self.policy()._replace(**changes)
        if new.mode not in ("auto", "manual", "offline") or min(new.json_ttl, new.image_ttl, new.pace) < 0:
            raise ValueError("a mode of auto, manual or offline, and times of at least 0, are required")
        with self.lock():
            sinks.create_file(self.spark, f"{self.folder}/policy.json", json.dumps(new._asdict(), sort_keys=True).encode(), overwrite=True)
        return new

    @contextmanager
    def lock(self, patience: float = 4 * LEASE) -> Iterator[None]:
        """Holds the cache for one caller; the others wait."""
        path, token = f"{self.folder}/lock", uuid.uuid4().hex.encode()
        end = time.monotonic() + patience
        while not sinks.create_file(self.spark, path, token):
            since = sinks.modified(self.spark, path)
            if since is not None and time.time() - since > LEASE:
                sinks.remove(self.spark, path)
            elif time.monotonic() > end:
                raise TimeoutError("the cache is locked")
            else:
                time.sleep(ATTEMPT)
        try:
            yield
        finally:
            if sinks._exists(self.spark, path) and sinks.read_text(self.spark, path).encode() == token:  # else it was taken over
                sinks.remove(self.spark, path)

    def verify(self) -> dict[str, object]:
        """Whether every body that an entry names is there and is what its hash says."""
        named = cachelog.entries(self.events()).where("sha256 is not null").select("sha256").distinct()
        missing = named.join(self._read("bodies", BODIES).select("sha256"), "sha256", "left_anti").count()
        damaged = self.damaged().count()
        return {"ok": not missing and not damaged, "bodies": named.count(), "missing": missing, "damaged": damaged}

    def _append(self, url: str, kind: str, at: float, status: str, *, sha: str | None = None, body: bytes | None = None, error: str | None = None, answer: Answer | None = None) -> None:
        row = (self.generation() + 1, url, kind, float(at), status, sha, None if body is None else len(body), error, answer.status if answer else None, answer.retry_after if answer else None, answer.etag if answer else None, answer.modified if answer else None)
        if body is not None and sha is not None and not self._body(sha):
            self.spark.createDataFrame([(sha, bytearray(body))], BODIES).coalesce(1).write.mode("append").parquet(f"{self.folder}/bodies")
        sinks.append_events(self.spark.createDataFrame([row], EVENTS).coalesce(1), f"{self.folder}/events")

    def _body(self, sha: str | None) -> bytes | None:
        """The stored body of a hash, if it is there and is what the hash says."""
        found = self._read("bodies", BODIES).where(F.col("sha256") == sha).first() if sha else None
        return bytes(found.body) if found and hashlib.sha256(found.body).hexdigest() == sha else None

    def get(
        self,
        url: str,
        transport: Transport,
        now: float,
        *,
        kind: str = "json",
        mode: str | None = None,
        ttl: float | None = None,
        refresh: bool = False,
        seed: tuple[bytes, float] | None = None,
        clock: Callable[[], float] | None = None,
        sleep: Callable[[float], None] = time.sleep,
    ) -> Result:
        """The resource at ``url``; ``seed`` is (body, time of change) of a packaged copy.  ``now`` is when the caller asked; with
        ``clock`` it is read again once the cache is this caller's."""
        url = self.spark.range(1).select(normalized_url(F.lit(url)).alias("u")).first().u
        if url is None:
            raise ValueError("a public http(s) url without credentials is required")
        policy = self.policy()
        mode = "offline" if policy.mode == "offline" else mode or policy.mode
        life = ttl if ttl is not None else policy.image_ttl if kind == "image" else policy.json_ttl
        if life < 0 or mode not in ("auto", "manual", "offline", "refresh"):
            raise ValueError("a known mode and a life of at least 0 are required")
        with self.lock():
            return self._get(url, transport, now, clock() if clock else now, kind, mode, life, refresh or mode == "refresh", seed, policy.pace, sleep)

    def _get(self, url: str, transport: Transport, asked: float, now: float, kind: str, mode: str, life: float, refresh: bool, seed: tuple[bytes, float] | None, pace: float, sleep: Callable[[float], None]) -> Result:
        log = self.events().where(F.col("url") == url)
        entry = cachelog.entries(log).first()
        body = self._body(entry.sha256) if entry else None
        valid_at = entry.valid_at if entry else None
        fresh = mode in ("manual", "offline") or (mode == "auto" and valid_at is not None and now < valid_at + life)
        fresh = fresh and not (refresh and mode != "offline")
        # another caller has checked it since this one asked
        fresh = fresh or bool(entry and entry.checked_at is not None and now > asked and entry.checked_at >= asked)
        requests = self.events().where(F.col("status").isin(*REQUESTED))
        blocked = cachelog.host_blocks(requests).where(F.col("host") == urlsplit(url).hostname).agg(F.max("blocked_until")).first()[0]
        lit = lambda x, t: F.lit(x).cast(t)
        action = (
            self.spark.range(1)
            .select(cachelog.decision(F.lit(mode), F.lit(body is not None), F.lit(fresh), lit(entry.retry_at if entry else None, "double"), lit(blocked, "double"), F.lit(float(now)), F.lit(entry is not None), F.lit(seed is not None)).alias("x"))
            .first()
            .x
        )
        if action == "adopt":
            data, changed = seed
            self._append(url, kind, changed, "adopted", sha=hashlib.sha256(checked(kind, data)).hexdigest(), body=data)
            return Result("adopted", data)
        if action in ("hit", "offline-hit", "stale-backoff"):
            return Result(action, body)
        if action == "error":
            raise CacheMiss(url)
        old = log.where("etag is not null or modified is not null").orderBy(F.desc("id")).first() if body is not None else None
        answer = None
        last = requests.agg(F.max("at")).first()[0]
        if last is not None and (wait := last + pace - now) > 0 and last <= now:
            sleep(wait)
            now += wait
        try:
            answer = transport(url, old.etag if old else None, old.modified if old else None)
            if answer.status == 304:
                if body is None or old is None:
                    raise ValueError("an unasked 304")
                self._append(url, kind, now, "not-modified", sha=entry.sha256, answer=answer)
                return Result("not-modified", body)
            if answer.status != 200:
                raise ValueError(f"HTTP {answer.status}")
            data = checked(kind, answer.body)
        except Exception as e:  # whatever a transport or a payload gets wrong is an event
            self._append(url, kind, now, "failed", error=str(e)[:500], answer=answer)
            if body is None:
                raise CacheMiss(url) from e
            return Result("stale-error", body)
        sha = hashlib.sha256(data).hexdigest()
        status = "unchanged" if entry and entry.sha256 == sha else "downloaded"
        self._append(url, kind, now, status, sha=sha, body=data, answer=answer)
        return Result(status, data)

    def update(self, transport: Transport, now: float, *, refresh: bool = False, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
        """Looks at what is due (with ``refresh`` at everything), one resource after another; how often each status came."""
        rows = cachelog.entries(self.events()).join(self.events().groupBy("url").agg(F.max_by("kind", "id").alias("kind")), "url")
        wanted = (rows if refresh else cachelog.due(rows, now)).select("url", "kind").orderBy("url")
        out: dict[str, int] = {}
        for url, kind in wanted.toLocalIterator():
            try:
                status = self.get(url, transport, now, kind=kind, refresh=refresh, sleep=sleep).status
            except CacheMiss:
                status = "failed"
            out[status] = out.get(status, 0) + 1
        return out

    def damaged(self) -> DataFrame:
        """(sha256) of stored bodies that are not what their hash says."""
        return self._read("bodies", BODIES).where(F.sha2("body", 256) != F.col("sha256")).select("sha256")


def http(timeout: float = 60.0) -> Transport:
    """A transport over HTTP with the standard library."""
    import email.utils
    import urllib.error
    import urllib.request

    def seconds(value: str | None) -> float | None:
        try:
            return float(value) if value else None
        except ValueError:
            try:
                return max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - time.time())
            except (ValueError, TypeError):
                return None

    def run(url: str, etag: str | None, modified: str | None) -> Answer:
        headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
                return Answer(answer.status, answer.read((64 << 20) + 1), answer.headers.get("ETag"), answer.headers.get("Last-Modified"))
        except urllib.error.HTTPError as e:
            return Answer(e.code, retry_after=seconds(e.headers.get("Retry-After")))

    return run
