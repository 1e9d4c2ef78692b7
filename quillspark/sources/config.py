"""Settings from .env files; the process environment overrides only absent keys."""

from __future__ import annotations

import os


def load_env(paths: list[str]) -> dict[str, str]:
    """Keys of the first file there is, and the environment's other ones."""
    found: dict[str, str] = {}
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    key, sep, value = line.strip().partition("=")
                    if sep and not key.startswith("#"):
                        found[key.strip()] = value.strip().strip("\"'")
            break
    return {**os.environ, **found}


def roster(env: dict[str, str], key: str = "JUDGES", default: tuple[str, ...] = ()) -> list[str]:
    return [n.strip() for n in env.get(key, ",".join(default)).split(",") if n.strip()]
