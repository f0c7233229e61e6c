"""Settings in layers: defaults, a JSON file, the environment; invalid values fall back to defaults."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, fields, is_dataclass, replace
from pathlib import Path

from quire.params import Settings

PREFIX = "QUIRE_"


def _coerced(value: object, like: object) -> object:
    if isinstance(like, bool):
        if isinstance(value, bool):
            return value
        text = str(value).strip().lower()
        if text not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(value)
        return text in ("1", "true", "yes", "on")
    if isinstance(like, tuple):
        return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
    return type(like)(value)


def merged(settings, values: dict):
    """``settings`` with nested ``values``; names that aren't there are ignored, bad values leave the old one."""
    changes = {}
    for f in fields(settings):
        if f.name not in values:
            continue
        old, new = getattr(settings, f.name), values[f.name]
        try:
            changes[f.name] = merged(old, new) if is_dataclass(old) else _coerced(new, old)
        except (TypeError, ValueError, AttributeError):
            continue
    return replace(settings, **changes)


def from_environment(settings: Settings, environment: dict[str, str]) -> Settings:
    """Variables like QUIRE_ROUTING__MIN_WORDS or QUIRE_FUSION."""
    values: dict = {}
    for name, value in environment.items():
        if name.startswith(PREFIX):
            *path, leaf = name[len(PREFIX) :].lower().split("__")
            at = values
            for part in path:
                at = at.setdefault(part, {})
            at[leaf] = value
    return merged(settings, values)


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    settings = Settings()
    if path and Path(path).exists():
        try:
            settings = merged(settings, json.loads(Path(path).read_text(encoding="utf-8")))
        except (ValueError, TypeError, AttributeError):
            pass
    return from_environment(settings, dict(os.environ) if environment is None else environment)


def save(settings: Settings, path: str) -> None:
    target = Path(path)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(asdict(settings), indent=2), encoding="utf-8")
    part.replace(target)


def redacted(values: dict) -> dict:
    """A snapshot without secrets."""
    return {k: redacted(v) if isinstance(v, dict) else "***" if v and any(s in k.lower() for s in ("key", "token_value", "password", "secret")) else v for k, v in values.items()}
