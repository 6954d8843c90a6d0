"""The boundary to language models: what an engine that needs one calls, and two that need none."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from typing import Any, Protocol


class Provider(Protocol):
    """Ships to the workers by pickling, so it holds settings only."""

    def analyze_plot(self, text: str) -> dict[str, Any]: ...
    def analyze_characters(self, text: str) -> list[dict[str, Any]]: ...
    def extract_features(self, text: str) -> list[str]: ...
    def embed(self, text: str) -> list[float]: ...


class NoProvider:
    """Answers nothing; searches fall back to keywords."""

    def analyze_plot(self, text: str) -> dict[str, Any]:
        return {"summary": ""}

    def analyze_characters(self, text: str) -> list[dict[str, Any]]:
        return []

    def extract_features(self, text: str) -> list[str]:
        return []

    def embed(self, text: str) -> list[float]:
        return []


class HashProvider(NoProvider):
    """Deterministic stand-in: the first sentence as summary, and hashed character pairs as a vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def analyze_plot(self, text: str) -> dict[str, Any]:
        import re

        return {"summary": re.split(r"(?<=[。！？.!?])", text.strip(), maxsplit=1)[0][:200]}

    def embed(self, text: str) -> list[float]:
        out = [0.0] * self.dim
        for a, b in zip(text, text[1:]):
            h = int.from_bytes(hashlib.blake2b((a + b).encode("utf-8", "replace"), digest_size=8).digest(), "big")
            out[h % self.dim] += 1.0 if h >> 63 else -1.0
        return out if any(out) else []


class OpeningProvider(NoProvider):
    """Deterministic stand-in whose summary of a text is its beginning."""

    def __init__(self, chars: int = 120):
        self.chars = chars

    def analyze_plot(self, text: str) -> dict[str, Any]:
        return {"summary": text[: self.chars]}


class GatewayProvider(NoProvider):
    """A model behind HTTP: POST of JSON to ``/v1/analyze`` and ``/v1/embed``; failures give nothing."""

    def __init__(self, url: str, timeout: float = 60.0, max_chars: int = 4000):
        self.url, self.timeout, self.max_chars = url.rstrip("/"), timeout, max_chars

    def _post(self, path: str, body: dict[str, Any]) -> dict[str, Any]:
        request = urllib.request.Request(self.url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except (OSError, ValueError):
            return {}

    def analyze_plot(self, text: str) -> dict[str, Any]:
        return self._post("/v1/analyze", {"kind": "plot", "text": text}).get("result") or {"summary": ""}

    def embed(self, text: str) -> list[float]:
        return self._post("/v1/embed", {"text": text[: self.max_chars]}).get("vector") or []


REGISTRY: dict[str, type] = {"none": NoProvider, "hash": HashProvider, "opening": OpeningProvider, "gateway": GatewayProvider}


def register(name: str, provider: type) -> None:
    REGISTRY[name.lower()] = provider


def create(name: str, **settings: Any) -> Provider:
    if name.lower() not in REGISTRY:
        raise ValueError(f"no provider is called {name}")
    return REGISTRY[name.lower()](**settings)


class Limiter:
    """At most so many calls a second in one task."""

    def __init__(self, per_second: float):
        self.gap, self.next = (1.0 / per_second if per_second > 0 else 0.0), 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if self.next > now:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap
