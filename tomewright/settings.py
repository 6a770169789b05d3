"""Settings: defaults, then a JSON file, then the environment where a value is still the default."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    threshold: int = 70
    auto_apply: int = 85
    region: str = "com"
    layout: str = "nested_series"
    trust_folders: bool = True
    distrust_tags: bool = False
    distrust_opf: bool = False
    distrust_json: bool = False
    number_folders: bool = False
    model: str = ""
    ai_books_per_run: int = 300


def _typed(like: object, value: object) -> object:
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
    return type(like)(value)


def load(path: str, env: Mapping[str, str] | None = None, prefix: str = "TOMEWRIGHT_") -> Settings:
    base = Settings()
    told = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as fh:
            told = json.load(fh)
    out = replace(base, **{f.name: _typed(getattr(base, f.name), told[f.name]) for f in fields(base) if f.name in told})
    env = os.environ if env is None else env
    late = {f.name: _typed(getattr(base, f.name), env[prefix + f.name.upper()]) for f in fields(base) if prefix + f.name.upper() in env and getattr(out, f.name) == getattr(base, f.name)}
    return replace(out, **late)


def save(path: str, settings: Settings) -> None:
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as fh:
        json.dump(asdict(settings), fh, indent=2)
    os.replace(part, path)
