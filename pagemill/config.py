"""Settings of the service side: defaults, then a JSON file, then the environment."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping


@dataclasses.dataclass(frozen=True)
class Settings:
    """Bounds and lifetimes; every name can be given in the file, or in the environment in upper case with the prefix."""

    cache_ttl_seconds: int = 86_400
    file_cache_ttl_seconds: int = 3_600
    max_file_mb: float = 5
    max_depth: int = 3
    max_pages: int = 100
    rate_limit: int = 50
    rate_seconds: int = 3_600
    min_chunk_words: int = 64
    max_chunk_words: int = 512
    search_limit: int = 3
    only_main_content: bool = True


def _as(value: object, kind: type) -> object:
    if kind is bool and isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return int(float(value)) if kind is int else kind(value)


def load(text: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "PAGEMILL_") -> Settings:
    """Settings of a JSON text (an object; names that aren't settings are left out) and an environment, which wins."""
    given = {k.lower(): v for k, v in (json.loads(text) if text else {}).items()}
    environment = os.environ if environment is None else environment
    kinds = {f.name: {"int": int, "float": float, "bool": bool}[f.type] for f in dataclasses.fields(Settings)}
    given |= {k.removeprefix(prefix).lower(): v for k, v in environment.items() if k.startswith(prefix)}
    return Settings(**{k: _as(v, kinds[k]) for k, v in given.items() if k in kinds})
