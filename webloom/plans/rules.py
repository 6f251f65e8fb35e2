"""The rules language: JSON text to validated, defaulted, typed steps."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from webloom.errors import RulesError

SOURCES = ("html", "text", "json", "xml", "headers", "final_url")
SELECTORS = ("css", "xpath", "json", "xml", "regex", "ai", "ocr")


@dataclass(frozen=True)
class Field:
    name: str
    source: str
    selector_type: str
    selector: tuple[str, ...]
    attribute: str = "text"
    required: bool = False
    default: Any = None
    multiple: bool = False
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Link(Field):
    attribute: str = "attr:href"
    default: Any = ()
    multiple: bool = True
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    next_step: str | None = None
    meta_patch: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Middleware:
    enabled: bool = True
    type: str = "download"
    order: int = 100
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Runtime:
    schedule: dict = field(default_factory=dict)
    retry: dict = field(default_factory=dict)
    dedup: dict = field(default_factory=dict)

    def merged(self, over: Runtime) -> Runtime:
        return Runtime(*({**a, **b} for a, b in zip((self.schedule, self.retry, self.dedup), (over.schedule, over.retry, over.dedup))))


@dataclass(frozen=True)
class Fetch:
    mode: str = "http"
    method: str = "GET"
    headers: dict[str, list[str]] = field(default_factory=dict)
    body: bytes | None = None
    http: dict | None = None
    browser: dict | None = None


@dataclass(frozen=True)
class Step:
    id: str
    impl: str
    callback: str | None
    fetch: Fetch
    fields: tuple[Field, ...]
    links: tuple[Link, ...]
    runtime: Runtime
    middlewares: dict[str, Middleware]


@dataclass(frozen=True)
class Compiled:
    steps: tuple[Step, ...]

    def step(self, name: str) -> Step:
        for s in self.steps:
            if s.id == name:
                return s
        raise RulesError(f"step not found: {name}")


def _number(v: Any) -> float | None:
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None


def _text(v: Any) -> str | None:
    return v if isinstance(v, str) else None


def validate(root: Any) -> None:
    """RulesError with what is wrong first."""
    if not isinstance(root, dict):
        raise RulesError("rules dsl must be an object")
    if not isinstance(root.get("steps"), list):
        raise RulesError("rules.steps must be an array")
    ids: set[str] = set()
    for step in root["steps"]:
        if not isinstance(step, dict):
            raise RulesError("rules.steps[*] must be an object")
        name = step.get("id")
        if not isinstance(name, str) or not name:
            raise RulesError("rules.steps[*].id is required")
        if name in ids:
            raise RulesError(f"duplicate step id: {name}")
        ids.add(name)
        _validate_step(name, step)


def _validate_step(name: str, step: dict) -> None:
    impl = _text(step.get("impl"))
    if impl is None:
        raise RulesError(f"step {name} missing impl")
    if impl == "dsl" and "callback" in step:
        raise RulesError(f"step {name} with impl=dsl must not define callback")
    if impl == "code" and _text(step.get("callback")) is None:
        raise RulesError(f"step {name} with impl=code must define callback")
    if impl not in ("dsl", "code"):
        raise RulesError(f"step {name} has unsupported impl: {impl}")
    for part in ("fetch", "parse"):
        if part in step and not isinstance(step[part], dict):
            raise RulesError(f"step {name} {part} must be an object")
        if part == "fetch" and part in step:
            mode = _text(step["fetch"].get("mode"))
            if mode not in (None, "http", "browser"):
                raise RulesError(f"step {name} has unsupported fetch.mode: {mode}")
    parse = step.get("parse", {})
    for part, one in (("fields", "field"), ("links", "link")):
        if part not in parse:
            continue
        if not isinstance(parse[part], list):
            raise RulesError(f"step {name} parse.{part} must be an array")
        for entry in parse[part]:
            if not isinstance(entry, dict):
                raise RulesError(f"step {name} parse.{part}[*] must be an object")
            for key in ("name", "source", "selector_type"):
                if not _text(entry.get(key)):
                    raise RulesError(f"step {name} {one}.{key} is required")
            if not isinstance(entry.get("selector"), list):
                raise RulesError(f"step {name} {one}.selector must be an array")
            if not all(isinstance(x, str) for x in entry["selector"]):
                raise RulesError(f"step {name} {one}.selector entries must be strings")
            if one == "link" and "to" in entry:
                if not isinstance(entry["to"], dict):
                    raise RulesError(f"step {name} link.to must be an object")
                if _text(entry["to"].get("next_step")) is None:
                    raise RulesError(f"step {name} link.to.next_step is required")


def _object(v: Any) -> dict:
    return dict(v) if isinstance(v, dict) else {}


def _flag(entry: dict, key: str, default: bool) -> bool:
    return entry[key] if isinstance(entry.get(key), bool) else default


def _strings(v: Any, label: str) -> tuple[str, ...]:
    if v is None:
        return ()
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
        raise RulesError(f"{label} must be an array of strings")
    return tuple(v)


def _common(entry: dict, attribute: str, multiple: bool, default: Any) -> dict:
    source, kind = entry["source"], entry["selector_type"]
    if source not in SOURCES and not source.startswith("meta."):
        raise RulesError(f"unsupported parse source: {source}")
    if kind not in SELECTORS:
        raise RulesError(f"unsupported selector_type: {kind}")
    return {"name": entry["name"], "source": source, "selector_type": kind, "selector": tuple(entry["selector"]), "attribute": entry["attribute"] if isinstance(entry.get("attribute"), str) else attribute, "required": _flag(entry, "required", False), "default": entry.get("default", default), "multiple": _flag(entry, "multiple", multiple), "options": _object(entry.get("options"))}


def _field(entry: dict) -> Field:
    return Field(**_common(entry, "text", False, None))


def _link(entry: dict) -> Link:
    to = _object(entry.get("to"))
    return Link(**_common(entry, "attr:href", True, []), allow=_strings(entry.get("allow"), "parse.links[*].allow"), deny=_strings(entry.get("deny"), "parse.links[*].deny"), next_step=_text(to.get("next_step")), meta_patch=_object(to.get("meta_patch")))


def _pairs(v: Any, label: str, what: str) -> dict[str, str]:
    if v is None:
        return {}
    if not isinstance(v, dict):
        raise RulesError(f"{label} must be an object")
    for key, x in v.items():
        if not isinstance(x, str):
            raise RulesError(f"{what} value for {key} must be string")
    return dict(v)


def _fetch(v: dict) -> Fetch:
    request, browser = _object(v.get("request")), _object(v.get("browser"))
    mode = _text(v.get("mode")) or "http"
    headers = {k: [x] for k, x in _pairs(request.get("headers"), "fetch.request.headers", "header").items()}
    body = request.get("body")
    if body is not None and not isinstance(body, str):
        raise RulesError("fetch.request.body must be string or null")
    http = view = None
    if mode == "http":
        http = {"query": _pairs(request.get("query"), "fetch.request.query", "query"), "cookies": _pairs(request.get("cookies"), "fetch.request.cookies", "cookie"), "allow_redirects": _flag(request, "allow_redirects", False)}
    else:
        view = browser_config(browser)
    return Fetch(mode, _text(request.get("method")) or "GET", headers, body.encode() if body is not None else None, http, view)


DRIVERS = {"chromiumoxide": "chromiumoxide", "headless_chrome": "headless_chrome", "headless-chrome": "headless_chrome", "playwright": "playwright"}
ENGINES = {"chromium": "chromium", "chrome": "google_chrome", "google_chrome": "google_chrome", "google-chrome": "google_chrome"}


def browser_config(v: dict) -> dict:
    out: dict[str, Any] = {"driver": None, "engine": None, "headless": True, "stealth": False, "fingerprint_profile": None, "wait_for": None, "width": 1280, "height": 720}
    for key, known in (("driver", DRIVERS), ("engine", ENGINES)):
        name = _text(v.get(key))
        if name is not None:
            out[key] = known.get(name, name)
    for key in ("headless", "stealth"):
        out[key] = _flag(v, key, out[key])
    for key in ("fingerprint_profile", "wait_for"):
        out[key] = _text(v.get(key))
    if "viewport" in v:
        if not isinstance(v["viewport"], dict):
            raise RulesError("fetch.browser.viewport must be an object")
        for key in ("width", "height"):
            n = _number(v["viewport"].get(key))
            out[key] = max(0, int(n)) if n is not None else out[key]
    return out


def _sections(v: dict) -> Runtime:
    for key in ("schedule", "retry", "dedup"):
        if key in v and not isinstance(v[key], dict):
            raise RulesError(f"step.runtime.{key} must be an object")
    return Runtime(*(dict(v.get(k, {})) for k in ("schedule", "retry", "dedup")))


def middlewares(v: Any) -> dict[str, Middleware]:
    if v is None:
        return {}
    if not isinstance(v, dict):
        raise RulesError("step MIDDLEWARES must be an object")
    out = {}
    for key, entry in v.items():
        if not isinstance(entry, dict):
            raise RulesError(f"MIDDLEWARES.{key} must be an object")
        kind = _text(entry.get("type")) or "download"
        if kind not in ("download", "spider"):
            raise RulesError(f"MIDDLEWARES.{key}.type: unsupported {kind}")
        order = _number(entry.get("order"))
        out[key] = Middleware(_flag(entry, "enabled", True), kind, int(order) if order is not None else 100, _object(entry.get("options")))
    return out


def compile_rules(value: str | dict) -> Compiled:
    """From JSON text or what it says."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError as e:
            raise RulesError(f"invalid rules json: {e}") from e
    validate(value)
    steps = []
    for s in value["steps"]:
        parse = s.get("parse", {})
        steps.append(Step(s["id"], s["impl"], _text(s.get("callback")), _fetch(s.get("fetch", {})), tuple(_field(f) for f in parse.get("fields", [])), tuple(_link(x) for x in parse.get("links", [])), _sections(_object(s.get("runtime"))), middlewares(s.get("MIDDLEWARES"))))
    return Compiled(tuple(steps))


def _inline(options: dict) -> Compiled:
    if "value" not in options:
        raise RulesError("inline rules need options.value")
    return compile_rules(options["value"])


def _local(options: dict) -> Compiled:
    path = options.get("path")
    if not isinstance(path, str):
        raise RulesError("local rules need options.path")
    try:
        return compile_rules(Path(path).read_text())
    except OSError as e:
        raise RulesError(f"rules file can't be read: {e}") from e


RULE_SOURCES: dict[str, Callable[[dict], Compiled]] = {"inline": _inline, "local": _local}


def load(config: dict) -> Compiled:
    """config: {"type": ..., "options": {...}}."""
    kind = config.get("type")
    if kind not in RULE_SOURCES:
        raise RulesError(f"unsupported rules source type: {kind}")
    return RULE_SOURCES[kind](config.get("options", {}))


# --- runtime sections to middleware ----------------------------------------------------------------


def lower(runtime: Runtime) -> dict[str, Middleware]:
    out: dict[str, Middleware] = {}
    retry = runtime.retry
    count = _number(retry.get("count"))
    options: dict[str, Any] = {} if count is None else {"count": [count]}
    backoff = retry.get("backoff_ms")
    if isinstance(backoff, list):
        options["backoff_ms"] = list(backoff)
    statuses = retry.get("http_status") if isinstance(retry.get("http_status"), list) else None
    if statuses is not None:
        out["retry_by_status"] = Middleware(order=200, options={**options, "status": list(statuses)})
    if options or statuses is not None:
        out["retry_by_error"] = Middleware(order=210, options=options)
    if runtime.dedup and _flag(runtime.dedup, "enabled", True):
        out["dedup"] = Middleware(order=220, options=dict(runtime.dedup))
    for key, name, order in (("interval_ms", "interval_gate", 120), ("rate_per_minute", "rate_limit", 130)):
        if key in runtime.schedule:
            out[name] = Middleware(order=order, options={key: runtime.schedule[key]})
    return out


@dataclass(frozen=True)
class Settings:
    """Defaults of a run. runtime_override takes the place of what the other settings say."""

    download_delay_ms: int = 0
    concurrent_requests: int | None = 16
    concurrent_requests_per_domain: int = 8
    retry_times: int = 2
    retry_http_codes: tuple[int, ...] = (500, 502, 503, 504, 408)
    retry_backoff_ms: tuple[int, ...] = ()
    idle_ms: int = 5000
    dedup: bool = False
    runtime_override: Runtime | None = None
    middlewares: dict[str, Middleware] = field(default_factory=dict)
    dispatch_callbacks: bool = False
    resolve_urls: bool = False
    max_nacks: int = 1

    def runtime(self) -> Runtime:
        if self.runtime_override is not None:
            return self.runtime_override
        retry = {"count": self.retry_times, "http_status": list(self.retry_http_codes)}
        if self.retry_backoff_ms:
            retry["backoff_ms"] = list(self.retry_backoff_ms)
        schedule = {"interval_ms": self.download_delay_ms} if self.download_delay_ms else {}
        return Runtime(schedule, retry, {"enabled": True} if self.dedup else {})


def chain_of(settings: Settings, step: Step | None) -> dict[str, Middleware]:
    """Of a step; "parse" goes by the settings alone."""
    own = step if step is not None and step.id != "parse" else None
    runtime = settings.runtime().merged(own.runtime) if own else settings.runtime()
    return {**lower(runtime), **settings.middlewares, **(own.middlewares if own else {})}


# --- plugins ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plugin:
    name: str
    kind: str
    version: str = ""
    override: bool = False
    options: dict = field(default_factory=dict)


class PluginRegistry:
    def __init__(self) -> None:
        self._all: dict[tuple[str, str], Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        from webloom.errors import PluginError

        key = (plugin.kind, plugin.name)
        if key in self._all and not plugin.override:
            raise PluginError(f"plugin conflict: {plugin.kind}/{plugin.name}")
        self._all[key] = plugin

    def register_all(self, plugins: list[Plugin]) -> None:
        for p in plugins:
            self.register(p)

    def get(self, kind: str, name: str) -> Plugin | None:
        return self._all.get((kind, name))

    def all(self) -> list[Plugin]:
        return [self._all[k] for k in sorted(self._all)]

    def by_kind(self, kind: str) -> list[Plugin]:
        return [p for p in self.all() if p.kind == kind]


def load_plugin_manifest(path: str) -> list[Plugin]:
    from webloom.errors import PluginError

    try:
        text = tomllib.loads(Path(path).read_text())
        return [Plugin(p["name"], p["kind"], p.get("version", ""), p.get("override", False), p.get("options", {})) for p in text.get("plugins", [])]
    except (OSError, tomllib.TOMLDecodeError, KeyError) as e:
        raise PluginError(f"plugin manifest: {e}") from e
