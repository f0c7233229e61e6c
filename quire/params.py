"""Thresholds of the transcript operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Routing:
    enabled: bool = True
    use_text_layer: bool = True
    skip_blank_pages: bool = True
    detect_duplicates: bool = True
    min_words: int = 25
    min_quality: float = 0.7
    blank_ink: float = 0.002
    ink_threshold: int = 200
    thumbnail: int = 200


@dataclass(frozen=True)
class Confidence:
    max_repeated_lines: int = 6
    dense_ink: float = 0.06
    min_words_for_dense_page: int = 30
    min_language_ratio: float = 0.5
    fallback_enabled: bool = True
    max_fallback_share: float = 0.5


@dataclass(frozen=True)
class Documents:
    max_file_mb: float = 50.0
    max_pages: int = 0
    render_dpi: int = 120
    max_dimension: int = 2048


@dataclass(frozen=True)
class Chat:
    enabled: bool = True
    max_context: int = 24_000
    history_turns: int = 4


@dataclass(frozen=True)
class Output:
    engine_name: bool = True
    model_name: bool = True
    processing_time: bool = True
    token_usage: bool = True
    character_count: bool = True
    word_count: bool = True
    page_numbers: bool = True
    confidence: bool = True
    extracted_text: bool = True
    comparison: bool = True
    raw_results: bool = True
    logs: bool = True


@dataclass(frozen=True)
class Settings:
    routing: Routing = field(default_factory=Routing)
    confidence: Confidence = field(default_factory=Confidence)
    documents: Documents = field(default_factory=Documents)
    chat: Chat = field(default_factory=Chat)
    output: Output = field(default_factory=Output)
    engine_order: tuple[str, ...] = ("text_layer", "vision_a", "vision_b", "classic")
    fusion: str = "line_vote"
    changed_threshold: float = 0.55
    max_tokens: int = 3072


#: What each speed profile sets.
PROFILES = {
    "fast": {"render_dpi": 96, "max_dimension": 1600, "max_tokens": 2048, "fallback_enabled": False},
    "balanced": {"render_dpi": 120, "max_dimension": 2048, "max_tokens": 3072, "fallback_enabled": True},
    "accurate": {"render_dpi": 150, "max_dimension": 2048, "max_tokens": 4096, "fallback_enabled": True},
}


def with_profile(settings: Settings, name: str) -> Settings:
    p = PROFILES[name]
    return replace(
        settings,
        documents=replace(settings.documents, render_dpi=p["render_dpi"], max_dimension=p["max_dimension"]),
        confidence=replace(settings.confidence, fallback_enabled=p["fallback_enabled"]),
        max_tokens=p["max_tokens"],
    )


def profile_of(settings: Settings) -> str | None:
    """The profile that the settings match, or None for a mix of one's own (the dimension isn't looked at)."""
    now = (settings.documents.render_dpi, settings.max_tokens, settings.confidence.fallback_enabled)
    return next((n for n, p in PROFILES.items() if (p["render_dpi"], p["max_tokens"], p["fallback_enabled"]) == now), None)
