"""Detector configuration: defaults, merge, validation and list hygiene."""

from __future__ import annotations

import json
import posixpath
from dataclasses import asdict, dataclass, field, fields, replace

from . import features


@dataclass(frozen=True)
class Weights:
    pattern: int = 5
    method: int = 3
    head: int = 1
    upload: int = 20


@dataclass(frozen=True)
class Confirm:
    """Multi-event confirmation: events, seconds of observation, seconds within which equal events merge."""

    count: int = 2
    observe: int = 30
    merge: int = 5


@dataclass(frozen=True)
class DetectorConfig:
    """Settings of the detector; `ring` is the number of an address's last events that its behaviour is judged on."""

    enabled: bool = True
    report_only: bool = False
    high: int = 50
    medium: int = 30
    low: int = 10
    sensitivity: int = 2
    windows: tuple[int, int, int] = (10, 30, 60)
    weights: Weights = field(default_factory=Weights)
    confirm: Confirm = field(default_factory=Confirm)
    local_ttl: int = 3600
    cloud_ttl: int = 7200
    idle: int = 300
    ring: int = 512
    whitelist: tuple[str, ...] = ()
    trusted_subnets: tuple[str, ...] = ()
    skip_paths: tuple[str, ...] = tuple(features.SKIP_PATHS)
    honeypot_paths: tuple[str, ...] = ()
    sensitive_paths: tuple[str, ...] = tuple(features.SENSITIVE_PATHS)
    bot_agents: tuple[str, ...] = tuple(features.BOT_AGENTS)
    known_clients: tuple[str, ...] = tuple(features.KNOWN_CLIENTS)
    browser_agents: tuple[str, ...] = tuple(features.BROWSER_AGENTS)
    patterns: tuple[str, ...] = tuple(features.DANGEROUS_PATTERNS)


def merge(base: DetectorConfig, override: dict) -> DetectorConfig:
    """Values of `override` that are not zero or empty replace those of `base`; nested sections likewise."""
    known = {f.name for f in fields(base)}
    if unknown := set(override) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = {}
    for name, value in override.items():
        own = getattr(base, name)
        if isinstance(own, (Weights, Confirm)):
            out[name] = replace(own, **{k: v for k, v in dict(value).items() if v})
        elif value:
            out[name] = tuple(value) if isinstance(own, tuple) else value
    return replace(base, **out)


def validate(c: DetectorConfig) -> None:
    """Raise ValueError for settings that contradict each other."""
    if not 0 < c.low <= c.medium <= c.high:
        raise ValueError("scores must satisfy 0 < low <= medium <= high")
    if c.sensitivity not in (1, 2, 3):
        raise ValueError("sensitivity must be 1, 2 or 3")
    if any(w <= 0 for w in c.windows) or sorted(c.windows) != list(c.windows):
        raise ValueError("windows must be positive and ascending")
    if min(c.local_ttl, c.cloud_ttl, c.idle, c.ring) <= 0:
        raise ValueError("times to live, idle time and ring must be positive")


def reload(current: DetectorConfig, override: dict) -> DetectorConfig:
    """The merged configuration, or the current one if the new one does not hold."""
    try:
        new = merge(DetectorConfig(), override)
        validate(new)
        return new
    except (ValueError, TypeError):
        return current


def dumps(c: DetectorConfig) -> str:
    return json.dumps(asdict(c))


def loads(text: str) -> DetectorConfig:
    """The configuration that `dumps` has written."""
    base = DetectorConfig()
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    return DetectorConfig(**{n: kinds[n](**v) if isinstance(v, dict) else kinds[n](v) for n, v in json.loads(text).items()})


def decision_weights(cloud: float, frequency: float, detector: float) -> tuple[float, float, float]:
    """X11: weights of the composite decision; all positive, their sum within [0.5, 1.5]."""
    if min(cloud, frequency, detector) <= 0 or not 0.5 <= cloud + frequency + detector <= 1.5:
        raise ValueError("weights must be positive with a sum from 0.5 to 1.5")
    return cloud, frequency, detector


def sanitize_paths(paths: list[str]) -> list[str]:
    """F16: paths that start with / and never climb, cleaned, with a final / kept."""
    out = []
    for p in (x.strip() for x in paths):
        if p.startswith("/") and ".." not in p:
            clean = posixpath.normpath(p).replace("//", "/")
            out.append(clean + "/" if p.endswith("/") and clean != "/" else clean)
    return out


def feature_list(value: object) -> dict:
    """A list, one string or a mapping as {items, excludes, builtin, cloud}."""
    base = {"items": [], "excludes": [], "builtin": True, "cloud": True}
    if value is None:
        return base
    if isinstance(value, str):
        return base | {"items": [value]}
    if isinstance(value, dict):
        return base | {k: value[k] for k in base if k in value}
    return base | {"items": list(value)}
