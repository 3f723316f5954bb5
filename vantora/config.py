"""Settings from a file and from the environment.

A TOML or JSON file gives nested settings; environment variables that begin with a prefix replace them, with ``__``
between the levels: ``APP__SERVER__PORT=8080`` sets ``server.port``. Texts become the type of the value they replace.
"""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from pathlib import Path

PREFIX, LEVEL = "APP__", "__"


def _as(text: str, like):
    """The text in the type of another value; without one, what it denotes in JSON, else a text."""
    if isinstance(like, bool):
        low = text.strip().lower()
        if low not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
            raise ValueError(f"no truth value: {text!r}")
        return low in ("true", "1", "yes", "on")
    if isinstance(like, (int, float)):
        return type(like)(text)
    if isinstance(like, list):
        return json.loads(text) if text.lstrip().startswith("[") else [x.strip() for x in text.split(",") if x.strip()]
    if like is None:
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text


def _merged(base: dict, over: Mapping) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | None = None, defaults: Mapping | None = None, environ: Mapping[str, str] | None = None, prefix: str = PREFIX) -> dict:
    """Defaults, then the file if there is one, then the environment; the last one holds."""
    settings = _merged({}, defaults or {})
    if path is not None and Path(path).exists():
        text = Path(path).read_text("utf-8")
        settings = _merged(settings, json.loads(text) if path.endswith(".json") else tomllib.loads(text))
    for name, text in sorted((os.environ if environ is None else environ).items()):
        if not name.startswith(prefix):
            continue
        *levels, last = name[len(prefix) :].lower().split(LEVEL)
        at = settings
        for level in levels:
            if not isinstance(at.get(level), dict):
                at[level] = {}
            at = at[level]
        at[last] = _as(text, at.get(last))
    return settings
