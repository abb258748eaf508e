"""Limits and thresholds with their defaults."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    target_words: int = 400
    max_words: int = 500
    overlap_words: int = 60
    rrf_k: int = 2
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_avg_len: float = 256.0
    content_threshold: float = 0.2
    relation_threshold: float = 0.35
    binding_threshold: float = 0.2
    link_threshold: float = 0.35
    document_root_threshold: float = 0.5
    seed_keep_threshold: float = 0.5
    max_seeds: int = 4
    max_expanded: int = 4
    max_paths: int = 2
    max_root_rules: int = 2
    max_links_scanned: int | None = 1000
    max_segments: int = 12
    max_links_per_node: int = 5
    max_pairs_per_link: int = 3
    segment_hits: int = 30
    binding_candidates: int = 40
    max_bindings: int = 20
    rule_candidates: int = 12
    max_links_per_rule: int = 5
    graph_documents: int = 250
    graph_nodes: int = 250
    graph_links: int = 1000
    context_sources: int = 10
    context_chars: int = 24_000
    batch_chunks: int = 10
    batch_chars: int = 12_000
    min_confidence: float = 0.6
    max_statement: int | None = 2000
    max_quote: int = 4000
    max_rules: int | None = 100


DEFAULTS = Settings()


def threshold(name: str, default: float, environ: dict[str, str] | None = None) -> float:
    """A score threshold from the environment; the default where it is missing or no number within 0 and 1."""
    raw = (os.environ if environ is None else environ).get(name, "")
    try:
        value = float(raw)
    except ValueError:
        return default
    return value if math.isfinite(value) and 0.0 <= value <= 1.0 else default
