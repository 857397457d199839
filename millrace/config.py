"""Settings of ranking, search and crawling, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Weights:
    """The share of each signal in the composite score."""

    relevance: float = 0.35
    field_match: float = 0.15
    field_of_study: float = 0.15
    trust: float = 0.10
    freshness: float = 0.15
    urgency: float = 0.10

    def __post_init__(self) -> None:
        values = (self.relevance, self.field_match, self.field_of_study, self.trust, self.freshness, self.urgency)
        if any(w < 0 or math.isnan(w) for w in values):
            raise ValueError("weights must not be negative")
        if abs(sum(values) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")


@dataclass(frozen=True)
class RankerConfig:
    """Knobs of the ranking signals."""

    weights: Weights = field(default_factory=Weights)
    half_life_hours: float = 14 * 24.0
    urgency_window_hours: float = 60 * 24.0
    no_deadline_urgency: float = 0.5
    max_trust_tier: int = 3

    def __post_init__(self) -> None:
        if self.half_life_hours <= 0 or self.urgency_window_hours <= 0:
            raise ValueError("half-life and window must be positive")
        if not 0 <= self.no_deadline_urgency <= 1:
            raise ValueError("no_deadline_urgency must be in [0, 1]")
        if self.max_trust_tier < 1:
            raise ValueError("max_trust_tier must be at least 1")


@dataclass(frozen=True)
class SearchConfig:
    """Limits of search and suggestions."""

    fuzzy_tolerance: int = 2
    default_page_size: int = 10
    max_page_size: int = 50
    max_query_length: int = 200
    suggest_limit: int = 5
    search_timeout_seconds: int = 5

    def __post_init__(self) -> None:
        if self.default_page_size < 1 or self.max_page_size < self.default_page_size:
            raise ValueError("page sizes must be positive, the default within the maximum")
        if self.fuzzy_tolerance < 0 or self.max_query_length < 1:
            raise ValueError("tolerance must not be negative, the query length at least 1")

    @classmethod
    def from_settings(cls, settings: dict[str, str]) -> SearchConfig:
        """From text settings; what is missing or no whole number has its default."""
        names = {
            "FUZZY_TOLERANCE": "fuzzy_tolerance", "DEFAULT_PAGE_SIZE": "default_page_size", "MAX_PAGE_SIZE": "max_page_size",
            "MAX_QUERY_LENGTH": "max_query_length", "SUGGEST_LIMIT": "suggest_limit", "SEARCH_TIMEOUT_SECONDS": "search_timeout_seconds",
        }
        found = {}
        for key, name in names.items():
            try:
                found[name] = int(settings.get(key, "").strip())
            except ValueError:
                continue
        return cls(**found)


def query_text(q: str | None, config: SearchConfig = SearchConfig()) -> str:
    """A search text, trimmed; blank or too long ones are refused."""
    text = (q or "").strip()
    if not text:
        raise ValueError("q is required")
    if len(text) > config.max_query_length:
        raise ValueError(f"q is longer than {config.max_query_length} characters")
    return text


def page_number(value: str | int | None) -> int:
    """A page number from 1 on; blank is 1."""
    return _whole(value, 1, 1, None, "page")


def page_size(value: str | int | None, config: SearchConfig = SearchConfig()) -> int:
    """A page size within the limit; blank is the default."""
    return _whole(value, config.default_page_size, 1, config.max_page_size, "size")


def profile_text(value: str | None, config: SearchConfig = SearchConfig()) -> str:
    """A profile value, trimmed and cut; never an error."""
    return (value or "").strip()[: config.max_query_length]


def _whole(value: str | int | None, default: int, least: int, most: int | None, name: str) -> int:
    text = str(value if value is not None else "").strip()
    if not text:
        return default
    try:
        n = int(text)
    except ValueError as e:
        raise ValueError(f"{name} must be a whole number") from e
    if n < least or (most is not None and n > most):
        raise ValueError(f"{name} is out of range")
    return n
