"""Settings of a curation run, grouped in frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

from sievework import lexicons


@dataclass(frozen=True)
class PromptFormat:
    # The markers a training line is built from.
    context_token: str = "<context>"
    body_token: str = "<joke>"
    end_token: str = "<|endoftext|>"


@dataclass(frozen=True)
class LengthBounds:
    # The default bounds, all inclusive.
    min_words: int = 4
    max_words: int = 60
    max_chars: int = 400


@dataclass(frozen=True)
class NearDupSettings:
    # Jaccard threshold, signature length, words per shingle.
    threshold: float = 0.90
    num_perm: int = 128
    shingle_size: int = 3
    # Bands and rows per band; None picks the optimum for the threshold.
    bands: int | None = None
    rows: int | None = None
    # A bucket above this share of all memberships is joined by broadcast, so
    # at most 1 / hot_share rows of 24 bytes are ever broadcast.
    hot_share: float = 1e-5
    # Whether a collision counts only if the shingle sets reach the threshold.
    verify: bool = False
    # Pairs that meet one copy of a kept row's shingles; more get more copies.
    pairs_per_part: int = 50_000
    # Pairs that a round of verifying may list in any table, however small.
    least_pairs: int = 100_000


@dataclass(frozen=True)
class EmbeddingSettings:
    # Cosine floor and texts per encoder call.
    floor: float = 0.25
    batch_size: int = 256
    label_prompt: str = "a joke about {label}"


@dataclass(frozen=True)
class ScoreSettings:
    # Wanted words, similarity that counts as a copy, and weights.
    least_words: int = 8
    most_words: int = 40
    copy_from: float = 0.85
    # A shingle that more sets hold than this share of all that is compared, and
    # than this number, is no key of a join.
    hot_share: float = 1e-4
    least_hot: int = 200
    weights: dict[str, float] = field(
        default_factory=lambda: {"quality": 0.50, "relevance": 0.25, "novelty": 0.15, "clean": 0.10, "length": 0.0}
    )


@dataclass(frozen=True)
class SplitSettings:
    # Held-out share and seed.
    test_share: float = 0.05
    seed: int = 42


@dataclass(frozen=True)
class CurationConfig:
    """Everything `plans.clean` needs to know, with the usual defaults."""

    length: LengthBounds = field(default_factory=LengthBounds)
    near_dup: NearDupSettings = field(default_factory=NearDupSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    split: SplitSettings = field(default_factory=SplitSettings)
    prompt: PromptFormat = field(default_factory=PromptFormat)
    blocklist: tuple[str, ...] = lexicons.BLOCKLIST
    obfuscations: tuple[str, ...] = lexicons.OBFUSCATIONS
    meta_phrases: tuple[str, ...] = lexicons.META_PHRASES
    meta_patterns: tuple[tuple[str, str], ...] = lexicons.META_PATTERNS
    keywords: tuple[tuple[str, tuple[str, ...]], ...] = lexicons.CONTEXT_KEYWORDS
    fallback_label: str = lexicons.FALLBACK_LABEL
    # What may follow a keyword or blocked word: see `functions.lexicon`.
    match: str = "prefix"
    # Whether an "edit:" note must be at a word start.
    strict: bool = False
    # Whether content rules come before both dedup stages, so that a blocked row
    # takes none of its near copies with it.
    filters_first: bool = False
    # Fixed value: a score from here on counts as a positive example.
    positive_score: int = 100
