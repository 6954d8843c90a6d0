"""Settings of an engine, with one default each."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass
class Config:
    library: str = ""
    provider: str = "none"
    provider_settings: dict[str, Any] = field(default_factory=dict)
    vector_search: bool = True
    paragraph_search: bool = True
    hybrid_search: bool = True
    paragraph_min_chars: int = 60
    segment_max_chars: int = 4000
    analysis_max_chars: int = 8000
    embedding_max_chars: int = 4000
    chapter_pattern: str = r"第.{1,10}章|Chapter \d+"
    audit_min_length: int = 20
    audit_similarity: float = 0.72
    max_rounds: int = 3


def load(path: str) -> Config:
    """A JSON file's settings over the defaults; unknown names are refused. A missing file gives the defaults."""
    p = Path(path)
    given = json.loads(p.read_text(encoding="utf-8")) if p.exists() else {}
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**given)
