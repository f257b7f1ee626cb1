"""Engine settings: defaults, validation, layered loading and runtime patches."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields, replace
from typing import Any

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: str | float) -> float:
    """Seconds of a duration such as ``1h30m``, ``250ms`` or a plain number of seconds."""
    if isinstance(text, (int, float)):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text.lstrip("+-"))
    if "".join(a + b for a, b in parts) != text.lstrip("+-") or not parts:
        if text == "0":
            return 0.0
        raise ValueError(f"invalid duration {text}")
    total = sum(float(a) * _UNITS[b] for a, b in parts)
    return -total if text.startswith("-") else total


@dataclass(frozen=True)
class EngineConfig:
    """All settings, with the interface's default values."""

    data_path: str = "./data"
    compress: bool = True
    startup_repair: bool = True
    min_dimension: int = 3
    max_dimension: int = 1000
    max_neurons: int = 1_000_000
    idle_threshold: float = 30.0
    sleep_threshold: float = 300.0
    dormant_threshold: float = 1800.0
    decay_interval: float = 60.0
    consolidate_interval: float = 300.0
    prune_interval: float = 600.0
    persist_interval: float = 60.0
    reorg_interval: float = 900.0
    max_idle_time: float = 1800.0
    registry_enabled: bool = False
    vector_enabled: bool = True
    alpha: float = 0.6
    query_repeat: int = 2
    embed_context: int = 512
    sentiment_enabled: bool = True
    rate_limit: int = 10_000
    rate_window: float = 60.0
    allowed_origins: str = "http://localhost:6060"
    max_request_body: int = 1 << 20
    max_content_bytes: int = 64 * 1024
    # Learning and dynamics.
    decay_rate: float = 0.1
    edge_decay_rate: float = 0.01
    learning_rate: float = 0.1
    co_window: float = 5.0
    initial_weight: float = 0.2
    link_threshold: float = 0.3
    max_degree: int = 50

    def validate(self) -> EngineConfig:
        """This config, or a ``ValueError`` that lists every fault."""
        faults = []
        check = lambda ok, what: None if ok else faults.append(what)
        check(self.min_dimension >= 1, "min_dimension must be positive")
        check(self.max_dimension >= self.min_dimension, "max_dimension must not be below min_dimension")
        check(self.max_neurons >= 1, "max_neurons must be positive")
        for name in ("idle_threshold", "sleep_threshold", "dormant_threshold", "decay_interval", "consolidate_interval", "prune_interval", "persist_interval", "reorg_interval", "max_idle_time"):
            check(getattr(self, name) > 0, f"{name} must be positive")
        check(self.idle_threshold < self.sleep_threshold < self.dormant_threshold, "thresholds must rise from idle over sleep to dormant")
        check(0 <= self.alpha <= 1, "alpha must be 0 to 1")
        check(1 <= self.query_repeat <= 3, "query_repeat must be 1 to 3")
        check(self.embed_context >= 1, "embed_context must be positive")
        check(self.max_request_body >= 0, "max_request_body must not be negative")
        check(self.max_content_bytes >= 1, "max_content_bytes must be positive")
        if faults:
            raise ValueError("; ".join(faults))
        return self

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, overrides: dict[str, Any] | None = None) -> EngineConfig:
        """Defaults, then a JSON file, then ``RECALL_<FIELD>`` variables, then overrides; later layers win."""
        out = cls()
        if path:
            with open(path, encoding="utf-8") as f:
                out = out._with(json.load(f))
        env = dict(os.environ) if env is None else env
        out = out._with({f.name: env[k] for f in fields(cls) if (k := f"RECALL_{f.name.upper()}") in env})
        return out._with({k: v for k, v in (overrides or {}).items() if v is not None}).validate()

    def _with(self, values: dict[str, Any]) -> EngineConfig:
        return replace(self, **{k: self._cast(k, v) for k, v in values.items()})

    def _cast(self, name: str, value: Any) -> Any:
        was = getattr(self, name)
        if isinstance(was, bool):
            return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
        if isinstance(was, int):
            return int(value)
        if isinstance(was, float):
            return seconds(value) if isinstance(value, str) and not re.fullmatch(r"[-+]?[\d.]+", value) else float(value)
        return str(value)

    def patch(self, changes: dict[str, dict[str, Any]]) -> tuple[EngineConfig, list[str], list[str]]:
        """A new config with the runtime parameters of ``changes`` (by section and field), and what
        changed and what was rejected, each by its dotted name."""
        new, changed, rejected = self, [], []
        for section, own in changes.items():
            for key, value in own.items():
                dotted, name = f"{section}.{key}", RUNTIME.get((section, key))
                if name is None:
                    rejected.append(f"{dotted}: not a runtime parameter")
                    continue
                try:
                    cast = new._cast(name, value)
                except ValueError:
                    rejected.append(f"{dotted}: invalid duration {value}" if isinstance(value, str) else f"{dotted}: invalid value")
                    continue
                if name == "max_neurons" and cast < 1:
                    rejected.append(f"{dotted}: must be positive")
                elif name == "max_request_body" and cast < 0:
                    rejected.append(f"{dotted}: must be >= 0")
                elif name == "alpha" and not 0 <= cast <= 1:
                    rejected.append(f"{dotted}: must be 0.0–1.0")
                else:
                    new = replace(new, **{name: cast})
                    changed.append(dotted)
        return new, changed, rejected


#: (section, field) of the interface -> setting that may change at run time.
RUNTIME = {
    ("lifecycle", "idleThreshold"): "idle_threshold",
    ("lifecycle", "sleepThreshold"): "sleep_threshold",
    ("lifecycle", "dormantThreshold"): "dormant_threshold",
    ("daemons", "decayInterval"): "decay_interval",
    ("daemons", "consolidateInterval"): "consolidate_interval",
    ("daemons", "pruneInterval"): "prune_interval",
    ("daemons", "persistInterval"): "persist_interval",
    ("daemons", "reorgInterval"): "reorg_interval",
    ("worker", "maxIdleTime"): "max_idle_time",
    ("registry", "enabled"): "registry_enabled",
    ("matrix", "maxNeurons"): "max_neurons",
    ("security", "allowedOrigins"): "allowed_origins",
    ("security", "maxRequestBody"): "max_request_body",
    ("vector", "alpha"): "alpha",
}


def clamp(value: int | None, default: int, most: int) -> int:
    """``default`` for none or less than one, and at most ``most``."""
    return min(default if not value or value < 1 else int(value), most)


def parse_connection(text: str, scheme: str = "recall", port: int = 6060) -> dict[str, Any]:
    """Parts of ``scheme[+tls]://[user[:password]@]host[:port][,host...][/index]``."""
    m = re.fullmatch(rf"{re.escape(scheme)}(\+tls)?://(?:([^:@/]*)(?::([^@/]*))?@)?([^/?#]*)(?:/([^?#]*))?(?:[?#].*)?", text or "", re.S)
    if not m:
        raise ValueError(f"a connection string starts with {scheme}:// or {scheme}+tls://")
    hosts = [h if ":" in h else f"{h}:{port}" for x in m[4].split(",") if (h := x.strip())]
    if not hosts:
        raise ValueError("a connection string has at least one host")
    return {"tls": bool(m[1]), "user": m[2] or "", "password": m[3] or "", "hosts": hosts, "index_id": m[5] or ""}
