"""Two profiles of constants. H: hyperbolic recency, finer levels first. E: exponential recency, coarser levels first. They never mix."""

from __future__ import annotations

from dataclasses import dataclass

STATEMENT, BLOCK, MESSAGE, SESSION, AGENT = range(5)
LEVEL_NAMES = ("statement", "block", "message", "session", "agent")
DIM = 384
MAX_KEYWORDS, MAX_IDENTIFIERS, MAX_FILES = 32, 128, 64


@dataclass(frozen=True)
class Profile:
    name: str
    relevance: float = 0.6
    recency: float = 0.3
    level: float = 0.1
    semantic: float = 0.7
    keyword: float = 0.3
    k1: float = 1.2
    b: float = 0.75
    boosts: tuple[float, ...] = ()  # by level, then any other
    costs: tuple[int, ...] = ()  # tokens by level, then any other; empty: by bytes
    default_k: int = 10
    most_k: int | None = None


H = Profile("H", boosts=(1.0, 0.6, 0.3, 0.0, 0.0, 0.0))
E = Profile("E", boosts=(0.7, 0.8, 0.9, 1.0, 0.5, 0.5), costs=(50, 200, 500, 1000, 100, 100), most_k=100)
PROFILES = {"H": H, "E": E}


def level_code(level: int | str | None) -> int | None:
    """A level by name or number; None stays None."""
    if level is None or isinstance(level, int):
        return level
    if level.isdigit():
        return int(level)
    return LEVEL_NAMES.index(level)
