"""What happened around a time and place, asked of a provider on the executors; it is never asked unless a caller passes one in.

Requests and answers have the fields that the store's other tables imply; how they are asked, kept and joined back is a design of our own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirloom.operators.upsert import upsert
from heirloom.sources.progress import report, warn
from heirloom.sources.store import Store, settle

#: Answers a list of requests, in their order: each a mapping with status, version and events.  It may raise, and is then asked again.
Provider = Callable[[Sequence[Mapping]], Sequence[Mapping]]

#: How good an answer is.
STATUSES = ("ok", "partial", "unavailable")

#: Requests of one call, calls for one batch at most, and seconds before the second one, doubled for each after it.
BATCH, ATTEMPTS, WAIT = 50, 3, 0.5

#: Characters of answers that a task holds before it hands them on.
HELD = 1 << 22

ANSWER = "query_hash string, request_json string, response_json string, status string, version string"
COLUMNS = [c.split()[0] for c in ANSWER.split(", ")]


def with_requests(rows: DataFrame, most: int, scope: Sequence[str]) -> DataFrame:
    """Add request_json and query_hash, its sha256, to rows with lat, lon, radius_km, date_start, date_end and perhaps admin1, admin2, country.

    Requests are written in one order of fields, so equal ones have equal hashes.  Rows that lack a place or a time have none.
    """
    text = lambda c: (F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c)
    fields = [
        F.col("lat").alias("lat"), F.col("lon").alias("lon"), F.col("radius_km").alias("radiusKm"), F.col("date_start").alias("dateStart"), F.col("date_end").alias("dateEnd"), text("admin1"), text("admin2"), text("country"),
        F.lit(int(most)).alias("maxEvents"), F.array(*[F.lit(s) for s in scope]).cast("array<string>").alias("scopeTiers"),
    ]
    whole = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("radius_km").isNotNull() & F.col("date_start").isNotNull() & F.col("date_end").isNotNull()
    asked = F.when(whole, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    return rows.withColumn("request_json", asked).withColumn("query_hash", F.sha2("request_json", 256))


def _answered(provider: Provider, requests: list[dict], attempts: int, wait: float) -> list[Mapping | None]:
    """Answers to a batch, after a bounded number of calls; None for all if none of them gave as many answers as there are requests."""
    for n in range(attempts):
        if n:
            time.sleep(wait * 2 ** (n - 1))
        try:
            found = list(provider(requests))
            if len(found) == len(requests):
                return found
        except Exception:  # noqa: BLE001, S112 - whatever a provider raises is no answer
            continue
    return [None] * len(requests)


def _fields(request: dict, answer: Mapping | None) -> tuple[str, str, str]:
    """Events as JSON, status and version; an answer that is none, or malformed, is unavailable, and more events than were asked for make it partial."""
    try:
        events, status, version = list(answer["events"]), answer["status"], answer["version"]
        if status not in STATUSES or not isinstance(version, str) or not all(isinstance(e, Mapping) for e in events):
            raise ValueError(status)
        if len(events) > request["maxEvents"]:
            events, status = events[: request["maxEvents"]], "partial" if status == "ok" else status
        return json.dumps([dict(e) for e in events], sort_keys=True, ensure_ascii=False), status, version
    except (TypeError, KeyError, ValueError):
        return "[]", "unavailable", ""


def answers(frames: Iterator[pd.DataFrame], provider: Provider, batch: int, attempts: int, wait: float, held: int = HELD) -> Iterator[pd.DataFrame]:
    """Rows of ANSWER for requests.  Frames are as large as those that come in, however small a batch, but for answers of more than ``held`` characters together."""
    for frame in frames:
        rows: list[tuple] = []
        size = 0
        hashes, texts = frame["query_hash"].tolist(), frame["request_json"].tolist()
        for at in range(0, len(frame), batch):
            part = slice(at, at + batch)
            requests = [json.loads(r) for r in texts[part]]
            found = [_fields(r, a) for r, a in zip(requests, _answered(provider, requests, attempts, wait), strict=True)]
            rows.extend((h, r, *f) for h, r, f in zip(hashes[part], texts[part], found, strict=True))
            size += sum(len(f[0]) for f in found)
            if size > held:
                yield pd.DataFrame(rows, columns=COLUMNS)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)


def ask(misses: DataFrame, provider: Provider, batch: int = BATCH, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """Answers to distinct requests (query_hash, request_json), settled: each is asked for in one task, in batches of ``batch``.

    A task that is lost with its executor asks its own requests again; rows are named by their hash, so whatever was asked twice is one row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return answers(frames, provider, batch, attempts, wait)

    return settle(misses.repartition("query_hash").sortWithinPartitions("query_hash").mapInPandas(run, ANSWER), "context")


def enrich(rows: DataFrame, cache: DataFrame, provider: Provider | None, again: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``with_requests`` with context_status, context_events (JSON) and context_version, and the answers that are new.

    A request is asked for once, whatever number of rows make it, and not at all if ``cache`` (ANSWER) holds it: failures are kept as ``unavailable`` and count as held, but for
    statuses in ``again``.  Without a provider, or without a request, rows have null columns or what the cache holds.
    """
    held = cache.select("query_hash", "status", "response_json", "version").where(~F.col("status").isin(*again) if again else F.lit(True))
    fresh = None
    if provider is not None:
        misses = rows.where("query_hash IS NOT NULL").groupBy("query_hash").agg(F.min("request_json").alias("request_json")).join(held, "query_hash", "left_anti")
        fresh = ask(misses, provider, **options)
        held = held.unionByName(fresh.select(*held.columns))
    known = held.select("query_hash", F.col("status").alias("context_status"), F.col("response_json").alias("context_events"), F.col("version").alias("context_version"))
    return rows.join(known, "query_hash", "left"), fresh


def run(store: Store, provider: Provider, most: int = 10, scope: Sequence[str] = ("locality", "district"), again: Sequence[str] = (), **options) -> dict:
    """Ask for the context of all presence intervals of tiers in ``scope`` and keep the answers in the store's cache."""
    places = store.read("places").select(F.col("id").alias("place_id"), "lat", "lon", "admin1", "admin2", "country")
    rows = with_requests(store.read("presence_intervals").where(F.col("precision_tier").isin(*scope)).join(places, "place_id"), most, scope)
    cache = store.read("context_cache")
    found, fresh = enrich(rows, cache, provider, again, **options)
    found = settle(found.select("context_status"), "context")  # before the cache that it reads is replaced
    now = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    store.write("context_cache", upsert(cache, fresh.withColumn("fetched_at", F.lit(now)), ["query_hash"]))
    n = found.groupBy(F.coalesce("context_status", F.lit("none")).alias("s")).count().collect()
    counts = {r["s"]: r["count"] for r in n}
    warn("context", counts.get("unavailable", 0), "intervals have no context, as the provider gave none")
    return report("context", requests=fresh.count(), **{s: counts.get(s, 0) for s in (*STATUSES, "none")})
