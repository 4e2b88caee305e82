"""Configuration files in JSON, TOML and YAML, and their merging with what the command line says."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

APP = "spandrel"
FORMATS = {"json": "JSON", "toml": "TOML", "yaml": "YAML", "yml": "YAML"}
DEFAULTS = {"depth": 5, "max_pages": 200, "output": "text", "concurrency": 5}


class ConfigError(ValueError):
    """A configuration file that can't be read."""


@dataclass
class Config:
    """What a configuration file may say; None where it doesn't."""

    depth: int | None = None
    max_pages: int | None = None
    output: str | None = None
    cli: bool | None = None
    save: str | None = None
    external: bool | None = None
    verbose: bool | None = None
    ignore_redirects: bool | None = None
    keep_fragments: bool | None = None
    rate_limit: float | None = None
    concurrency: int | None = None
    respect_robots_txt: bool | None = None

    @classmethod
    def read(cls, path: str | os.PathLike) -> Config:
        path = Path(path)
        kind = FORMATS.get(path.suffix.lower().lstrip("."))
        if kind is None:
            raise ConfigError(f"Unsupported config file format: {path}")
        try:
            text = path.read_text(encoding="utf-8")
        except OSError as e:
            raise ConfigError(f"Failed to read config file {path}: {e}") from e
        try:
            return cls.of(_load(kind, text))
        except (ValueError, TypeError) as e:
            raise ConfigError(f"Failed to parse {kind} config {path}: {e}") from e

    @classmethod
    def of(cls, said: object) -> Config:
        """A config of parsed content; unknown keys are ignored, wrong types an error."""
        if said is None:
            said = {}
        if not isinstance(said, dict):
            raise TypeError("not a table of settings")
        kinds = {"depth": int, "max_pages": int, "concurrency": int, "rate_limit": (int, float), "output": str, "save": str}
        out = cls()
        for f in fields(cls):
            value = said.get(f.name)
            if value is None:
                continue
            kind = kinds.get(f.name, bool)
            if not isinstance(value, kind) or kind is not bool and isinstance(value, bool):
                raise TypeError(f"{f.name}: {value!r} has the wrong type")
            if kind is int and value < 0:
                raise ValueError(f"{f.name} must not be negative")
            if f.name == "output" and value not in ("text", "json"):
                raise ValueError(f"unknown output {value!r}")
            setattr(out, f.name, float(value) if f.name == "rate_limit" else value)
        return out

    @classmethod
    def discover(cls, home: Path | None = None) -> tuple[Config, Path] | None:
        """The first of the default files that exists, and its path; one that can't be parsed is an error."""
        for path in default_paths(home):
            if path.exists():
                return cls.read(path), path
        return None


def _load(kind: str, text: str) -> object:
    if kind == "JSON":
        return json.loads(text)
    if kind == "TOML":
        return tomllib.loads(text)
    import yaml

    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def default_paths(home: Path | None = None) -> list[Path]:
    """Here by the application's name, then in the user's folder of settings."""
    home = home or Path.home()
    base = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config") / APP
    return [*(Path(f"{APP}.{x}") for x in FORMATS), *(base / f"config.{x}" for x in FORMATS)]


@dataclass
class RuntimeOptions:
    """All settings of a run, resolved."""

    url: str | None = None
    depth: int = 5
    max_pages: int = 200
    output: str | None = None
    cli: bool = False
    tui: bool = False
    save: str | None = None
    external: bool = False
    verbose: bool = False
    ignore_redirects: bool = False
    keep_fragments: bool = False
    rate_limit: float | None = None
    concurrency: int = 5
    respect_robots_txt: bool = True
    config: str | None = None
    loaded_from: str | None = None


def resolve(said: dict, config: Config | None = None) -> RuntimeOptions:
    """The command line's word, then the file's, then the default; of switches, either turns one on.

    Only ``respect_robots_txt`` can be turned off over the file. url, tui and config come from the command line only.
    """
    config = config or Config()
    out = RuntimeOptions(url=said.get("url"), tui=bool(said.get("tui")), config=said.get("config"))
    for name in ("depth", "max_pages", "output", "save", "rate_limit", "concurrency"):
        given = said.get(name)
        value = given if given is not None else getattr(config, name)
        if value is not None:
            setattr(out, name, value)
    for name in ("cli", "external", "verbose", "ignore_redirects", "keep_fragments"):
        setattr(out, name, bool(said.get(name)) or bool(getattr(config, name)))
    for value in (said.get("respect_robots_txt"), config.respect_robots_txt):
        if value is not None:
            out.respect_robots_txt = value
            break
    return out
