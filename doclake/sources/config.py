"""Configuration: a TOML file over defaults, and values from the environment or an environment file."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

DEFAULTS = {"root": "", "platforms": {"notion": {"enabled": False, "token_env": ""}, "feishu": {"enabled": False}}, "inline_rows": 200, "retention_days": 30, "full_every": 4}


def load(path: str | Path) -> dict:
    """The file's values over :data:`DEFAULTS`, section by section; the defaults when there is no file."""

    def merge(base: dict, own: dict) -> dict:
        return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in own.items()}

    p = Path(path)
    return merge(DEFAULTS, tomllib.loads(p.read_text())) if p.exists() else merge(DEFAULTS, {})


def resolve_env(name: str, file_values: dict[str, str]) -> tuple[str, str]:
    """(value, where it is from): ``environment`` before ``file``; ('', 'unset')."""
    if os.environ.get(name):
        return os.environ[name], "environment"
    return (file_values[name], "file") if file_values.get(name) else ("", "unset")
