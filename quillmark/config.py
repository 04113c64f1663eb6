"""Settings of an analysis run: from a YAML or JSON file, overridden by the environment.

Unknown names and wrong types are refused. Paths in a file are relative to its folder. A service's address set in the environment
switches the service on. YAML needs its library; without it a file must be JSON, which YAML includes.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path

PREFIX = "QUILLMARK_"


@dataclass(frozen=True)
class Limits:
    max_file_size_mb: int = 100
    max_pages: int = 25
    max_images: int = 100
    max_photos: int = 20
    max_render_pixels: int = 25_000_000
    max_image_pixels: int = 50_000_000
    table_rows: int = 2000
    table_columns: int = 40


@dataclass(frozen=True)
class Points:
    online_service: float = 5.0
    pdf_editor: float = 3.0
    design_tool: float = 5.0
    visual_editor: float = 8.0
    generative_tool: float = 8.0
    invalid_signature: float = 20.0
    post_signature_change: float = 20.0
    structured_mismatch: float = 20.0
    malformed_content: float = 4.0


@dataclass(frozen=True)
class Service:
    enabled: bool = False
    url: str = ""
    timeout_seconds: int = 900


@dataclass(frozen=True)
class Config:
    output: str = "output"
    recursive: bool = True
    limits: Limits = field(default_factory=Limits)
    points: Points = field(default_factory=Points)
    recognition: Service = field(default_factory=lambda: Service(timeout_seconds=300))
    classification: Service = field(default_factory=Service)
    extraction: Service = field(default_factory=lambda: Service(timeout_seconds=1800))
    verification: Service = field(default_factory=lambda: Service(timeout_seconds=1800))
    synthesis: Service = field(default_factory=Service)


class ConfigError(ValueError):
    pass


def _merged(base, values, where: str):
    if not isinstance(values, dict):
        raise ConfigError(f"{where or 'the file'} must be a mapping")
    known, out = {f.name for f in fields(base)}, {}
    for name, value in values.items():
        at = f"{where}.{name}" if where else str(name)
        if name not in known:
            raise ConfigError(f"unknown setting: {at}")
        old = getattr(base, name)
        if is_dataclass(old):
            out[name] = _merged(old, value, at)
            continue
        if isinstance(old, float) and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if type(value) is not type(old):
            raise ConfigError(f"{at} must be of type {type(old).__name__}")
        if not isinstance(value, bool | str) and value < 0:
            raise ConfigError(f"{at} must not be negative")
        out[name] = value
    return replace(base, **out)


def _from_text(text: str, kind: type):
    if kind is bool:
        if text.lower() not in ("1", "0", "true", "false", "yes", "no"):
            raise ConfigError(f"not a boolean: {text}")
        return text.lower() in ("1", "true", "yes")
    try:
        return kind(text)
    except ValueError as e:
        raise ConfigError(str(e)) from None


def _overridden(base, environment: dict, prefix: str):
    out = {}
    for f in fields(base):
        old, name = getattr(base, f.name), prefix + f.name.upper()
        if is_dataclass(old):
            out[f.name] = _overridden(old, environment, name + "_")
        elif name in environment:
            out[f.name] = _from_text(environment[name], type(old))
    if isinstance(base, Service) and out.get("url") and "enabled" not in out:
        out["enabled"] = True
    return replace(base, **out)


def load(path: str | None = None, environment: dict | None = None) -> Config:
    """The settings: defaults, then the file, then the environment."""
    config = Config()
    if path is not None:
        text = Path(path).read_text(encoding="utf-8")
        try:
            import yaml
        except ImportError:
            values = json.loads(text) if text.strip() else {}
        else:
            values = yaml.safe_load(text) or {}
        config = _merged(config, values, "")
        if not os.path.isabs(config.output):
            config = replace(config, output=str(Path(path).resolve().parent / config.output))
    return _overridden(config, os.environ if environment is None else environment, PREFIX)


def session_conf(config: Config) -> dict[str, str]:
    """The settings as Spark configuration entries, for plans that read them from the session."""
    flat = {}
    for name, value in asdict(config).items():
        for key, v in value.items() if isinstance(value, dict) else [(None, value)]:
            flat[f"quillmark.{name}" + (f".{key}" if key else "")] = str(v).lower() if isinstance(v, bool) else str(v)
    return flat
