"""Requests of connectors: a checked query object, and retries and a small cache around any ``send`` function.

The library opens no connection by itself; ``send(method, url, **options)`` gives (status, headers, body).
"""

from __future__ import annotations

import hashlib
import json
import time
import warnings
from collections import OrderedDict
from dataclasses import dataclass, fields

RETRIED = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class ConnectorQuery:
    elements: tuple[str, ...] = ()
    source_ids: tuple[str, ...] = ()
    properties: tuple[str, ...] = ()
    max_records: int = 100
    page_size: int = 100

    def __post_init__(self):
        for name in ("elements", "source_ids", "properties"):
            object.__setattr__(self, name, tuple(dict.fromkeys(x.strip() for x in getattr(self, name) if x and x.strip())))
        if self.max_records < 1 or self.page_size < 1:
            raise ValueError("max_records and page_size must be at least 1")

    @property
    def pages(self) -> int:
        return -(-self.max_records // self.page_size)


def as_query(query: ConnectorQuery | None, legacy: dict) -> ConnectorQuery:
    """A query, or one made of old keyword arguments with a warning."""
    if query is not None and legacy:
        raise TypeError("give a query or keywords, not both")
    if query is not None:
        return query
    unknown = sorted(set(legacy) - {f.name for f in fields(ConnectorQuery)})
    if unknown:
        raise TypeError(f"unknown arguments: {unknown}")
    if legacy:
        warnings.warn("keyword arguments are deprecated; pass a ConnectorQuery", DeprecationWarning, stacklevel=2)
    return ConnectorQuery(**legacy)


@dataclass(frozen=True)
class Policy:
    timeout: float = 30.0
    retries: int = 2
    backoff: float = 0.5
    longest_wait: float = 30.0

    def __post_init__(self):
        if not (0 < self.timeout <= 120 and 0 <= self.retries <= 5 and self.backoff >= 0 and self.longest_wait >= 0):
            raise ValueError("policy out of bounds")


class ResponseCache:
    """Least recently used responses of GET requests."""

    def __init__(self, most: int = 32):
        self.most, self._kept = most, OrderedDict()

    @staticmethod
    def key(method: str, url: str, options: dict) -> str:
        return hashlib.sha256(json.dumps([method, url, options], sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str):
        if key in self._kept:
            self._kept.move_to_end(key)
        return self._kept.get(key)

    def put(self, key: str, value) -> None:
        self._kept[key] = value
        self._kept.move_to_end(key)
        while len(self._kept) > self.most:
            self._kept.popitem(last=False)


def request(send, method: str, url: str, policy: Policy = Policy(), cache: ResponseCache | None = None, sleep=time.sleep, **options):
    """The response, after retries of overload, server faults and lost connections with growing waits or the server's own."""
    key = ResponseCache.key(method, url, options) if cache is not None and method.upper() == "GET" else None
    if key and (kept := cache.get(key)) is not None:
        return kept
    for attempt in range(policy.retries + 1):
        try:
            status, headers, body = send(method, url, timeout=policy.timeout, **options)
        except (ConnectionError, TimeoutError):
            if attempt == policy.retries:
                raise
            headers = {}
        else:
            if status not in RETRIED or attempt == policy.retries:
                break
        asked = str(headers.get("Retry-After", ""))
        sleep(min(policy.longest_wait, float(asked) if asked.replace(".", "", 1).isdigit() else policy.backoff * 2**attempt))
    if key and status < 400:
        cache.put(key, (status, headers, body))
    return status, headers, body
