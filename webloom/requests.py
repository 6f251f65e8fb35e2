"""Requests as values: built on the driver, for seeds and for tests; a crawl's own are rows of FRONTIER."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from webloom.errors import RequestBuildError
from webloom.schemas import FRONTIER

MODES = ("http", "browser")


def meta_text(value: Any) -> str:
    """A meta value as the JSON text that the meta column holds."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def request_mode(name: str) -> str:
    if name not in MODES:
        raise RequestBuildError(f"unsupported request mode: {name}")
    return name


@dataclass(frozen=True)
class HttpConfig:
    query: Mapping[str, str] = field(default_factory=dict)
    cookies: Mapping[str, str] = field(default_factory=dict)
    allow_redirects: bool = False


@dataclass(frozen=True)
class BrowserConfig:
    driver: str | None = None
    engine: str | None = None
    headless: bool = True
    stealth: bool = False
    fingerprint_profile: str | None = None
    wait_for: str | None = None
    width: int = 1280
    height: int = 720

    def with_driver(self, driver: str) -> BrowserConfig:
        return replace(self, driver=driver)

    def with_engine(self, engine: str) -> BrowserConfig:
        return replace(self, engine=engine)

    def with_headless(self, on: bool) -> BrowserConfig:
        return replace(self, headless=on)

    def with_stealth(self, on: bool) -> BrowserConfig:
        return replace(self, stealth=on)

    def with_fingerprint_profile(self, profile: str) -> BrowserConfig:
        return replace(self, fingerprint_profile=profile)

    def with_wait_for(self, selector: str) -> BrowserConfig:
        return replace(self, wait_for=selector)

    def with_viewport(self, width: int, height: int) -> BrowserConfig:
        return replace(self, width=width, height=height)


@dataclass(frozen=True)
class Request:
    """Either an http request, with http, or a browser request, with browser; never both."""

    url: str
    mode: str = "http"
    method: str = "GET"
    headers: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    body: bytes | None = None
    meta: Mapping[str, Any] = field(default_factory=dict)
    callback: str | None = None
    dont_filter: bool = False
    http: HttpConfig | None = None
    browser: BrowserConfig | None = None

    def __post_init__(self) -> None:
        if request_mode(self.mode) == "http":
            object.__setattr__(self, "http", self.http or HttpConfig())
            object.__setattr__(self, "browser", None)
        else:
            object.__setattr__(self, "browser", self.browser or BrowserConfig())
            object.__setattr__(self, "http", None)

    @classmethod
    def in_browser(cls, url: str) -> Request:
        return cls(url, mode="browser")

    def with_mode(self, mode: str) -> Request:
        return replace(self, mode=mode)

    def with_method(self, method: str) -> Request:
        return replace(self, method=method)

    def with_header(self, name: str, value: str) -> Request:
        """One more value of that name."""
        return replace(self, headers={**self.headers, name: (*self.headers.get(name, ()), value)})

    def with_body(self, body: bytes | str) -> Request:
        return replace(self, body=body.encode() if isinstance(body, str) else body)

    def with_meta(self, key: str, value: Any) -> Request:
        return replace(self, meta={**self.meta, key: value})

    def merge_meta(self, patch: Mapping[str, Any]) -> Request:
        return replace(self, meta={**self.meta, **patch})

    def with_callback(self, name: str) -> Request:
        return replace(self, callback=name)

    def with_dont_filter(self, on: bool = True) -> Request:
        return replace(self, dont_filter=on)

    def with_cookie(self, name: str, value: str) -> Request:
        """Makes it an http request."""
        return self.with_cookies({name: value})

    def with_cookies(self, cookies: Mapping[str, str]) -> Request:
        http = self.http or HttpConfig()
        return self.with_http(replace(http, cookies={**http.cookies, **cookies}))

    def with_http(self, http: HttpConfig) -> Request:
        return replace(self, mode="http", http=http)

    def with_browser(self, browser: BrowserConfig) -> Request:
        return replace(self, mode="browser", browser=browser)

    def row(self, seq: int) -> tuple:
        """As FRONTIER has it."""
        return (seq, self.url, self.mode, self.method, {k: list(v) for k, v in self.headers.items()}, self.body, {k: meta_text(v) for k, v in self.meta.items()}, self.callback, self.dont_filter, _fields(self.http), _fields(self.browser), None, 0, 0)


def _fields(config) -> dict | None:
    return None if config is None else {k: dict(v) if isinstance(v, Mapping) else v for k, v in asdict(config).items()}


def frame(spark: SparkSession, requests: Iterable[Request | str], first: int = 0) -> DataFrame:
    """FRONTIER rows, numbered from ``first`` in their order. A string is a GET by http."""
    return spark.createDataFrame([(Request(r) if isinstance(r, str) else r).row(first + i) for i, r in enumerate(requests)], FRONTIER)
