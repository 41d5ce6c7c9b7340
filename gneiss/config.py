"""Engine settings, resolved from arguments, then the environment, then defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass


class MissingSetting(ValueError):
    """A required setting is neither given nor in the environment."""


def setting(name: str, given: str | None = None, default: str | None = None, required: bool = False) -> str | None:
    """The given value, else the environment's, else the default. Blank counts as unset."""
    for value in (given, os.environ.get(name), default):
        if value is not None and value.strip():
            return value.strip()
    if required:
        raise MissingSetting(name)
    return None


@dataclass(frozen=True)
class Retrieval:
    """Parameters of hybrid retrieval."""

    floor: float = 0.5
    rrf_k: int = 60
    top_k: int = 3
    candidates_k: int = 15
    rerank: bool = False

    @property
    def pool(self) -> int:
        """Hits handed to the reranker, or returned if there is none."""
        return self.candidates_k if self.rerank else self.top_k

    def fetch_k(self, limit: int) -> int:
        """Ranks that each side of the fusion keeps."""
        return max(30, 2 * limit)


@dataclass(frozen=True)
class Chunking:
    """Parameters of chunking, in characters."""

    size: int = 900
    overlap: int = 150
    max_safe: int = 1000
    prefix: int = 250
    cut_percentile: float = 0.85
    max_path: int = 150
    embed_chars: int = 3500
    batch: int = 32
