"""Settings: given in code, else by environment, else by file, else defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "TRAWLNET_"
FILE = "trawlnet.json"


@dataclass(frozen=True)
class Configuration:
    storage_dir: str = "./storage"
    purge_on_start: bool = True
    persist_state_interval_s: float = 60.0
    default_queue: str = "default"
    default_dataset: str = "default"
    default_store: str = "default"
    max_retries: int = 3


def load(file: str | None = FILE, environ: dict[str, str] | None = None, **given: object) -> Configuration:
    """The configuration; empty environment variables are unset, 0 and false are false."""
    environ = os.environ if environ is None else environ
    stored = json.loads(Path(file).read_text("utf-8")) if file and Path(file).exists() else {}
    out: dict[str, object] = {}
    for f in fields(Configuration):
        kind = type(f.default)
        if given.get(f.name) is not None:
            out[f.name] = given[f.name]
            continue
        text = environ.get(PREFIX + f.name.upper()) or None
        value = text if text is not None else stored.get(f.name)
        if value is not None:
            out[f.name] = str(value).lower() not in ("0", "false") if kind is bool else kind(value)
    return Configuration(**out)
