"""Typed settings with a dictionary overlay; unknown keys are ignored."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

# Default limits of the ingestion and retrieval flows.
MIN_CONTENT_CHARS = 300
MAX_CONTENT_CHARS = 500_000
MIN_MEANINGFUL_LINES = 3
MIN_YEAR = 1986
PARENT_CHARS = 8000
CHILD_CHARS = 1400
CHILD_OVERLAP = 260
CHILD_MIN_CHARS = 200
EMBEDDING_DIM = 768
SHARD_ROWS = 50_000
DEFAULT_TOP_K = 5
TOP_K_RANGE = (1, 20)
MESSAGE_CHARS_RANGE = (1, 4096)
COMPARE_MAX_ENTITIES = 4
COMPARE_EXTRAS_PER_ENTITY = 2
SUMMARIZE_FACTOR = 3
SUMMARIZE_CAP = 30
RERANK_CAP = 30
KEYWORD_BONUS = 0.05
HOP_CONTEXT_DOCS = 3
HOP_CONTEXT_CHARS = 400
GRAPH_MIN_SCORE = 0.15
GRAPH_NEIGHBORS = 3
GRAPH_NEIGHBOR_FACTOR = 0.8
GRAPH_DEFAULT_SCORE = 0.5
FALLBACK_MEAN_SCORE = 0.05
RULE_CONFIDENCE = 0.80
MODEL_DEFAULT_CONFIDENCE = 0.7
PARSE_ERROR_CONFIDENCE = 0.4
MODEL_ERROR_CONFIDENCE = 0.5
EXPANSION_CAP = 3
SUB_ENTITY_CAP = 4
MEMORY_WINDOW = 5
MEMORY_THRESHOLD = 8
MEMORY_BATCH = 3
MEMORY_TURN_CHARS = 800
WEB_MIN_CHARS = 100
WEB_MAX_CHARS = 2000
WEB_RESULTS = 3
TRUNCATE_KEEP_RATIO = 0.4
BREAKER_FAILURES = 3
BREAKER_COOLDOWN_SEC = 120
CACHE_TTL_SEC = 3600
CACHE_MAX_KEYS = 256
QUANTILE = 0.99
OVERSAMPLING = 1.5
HIT_THRESHOLD = 0.30
HIT_THRESHOLD_LONG = 0.45
HIT_LONG_TOKENS = 30
SAMPLE_TARGET = 100
SAMPLE_MIN_CHARS = 100
SAMPLE_SEED = 42
SAMPLE_MIN_PER_STRATUM = 3
NEGATIVE_RATIO = 0.10


@dataclass(frozen=True)
class Settings:
    """Everything a deployment may override."""

    min_content_chars: int = MIN_CONTENT_CHARS
    max_content_chars: int = MAX_CONTENT_CHARS
    min_meaningful_lines: int = MIN_MEANINGFUL_LINES
    skip_before_year: int = MIN_YEAR
    parent_size_chars: int = PARENT_CHARS
    child_size_chars: int = CHILD_CHARS
    child_overlap_chars: int = CHILD_OVERLAP
    min_child_chars: int = CHILD_MIN_CHARS
    embedding_dim: int = EMBEDDING_DIM
    shard_rows: int = SHARD_ROWS
    top_k: int = DEFAULT_TOP_K
    fallback_mean_score: float = FALLBACK_MEAN_SCORE
    graph_min_score: float = GRAPH_MIN_SCORE
    oversampling: float = OVERSAMPLING
    quantile: float = QUANTILE
    breaker_failures: int = BREAKER_FAILURES
    breaker_cooldown_sec: int = BREAKER_COOLDOWN_SEC
    cache_ttl_sec: int = CACHE_TTL_SEC
    cache_max_keys: int = CACHE_MAX_KEYS
    resume: bool = False
    dry_run: bool = False

    @classmethod
    def overlay(cls, values: Mapping[str, Any] | None = None) -> "Settings":
        """Defaults overlaid with the known keys of ``values``."""
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in (values or {}).items() if k in known})

    @classmethod
    def from_yaml(cls, path: str | None) -> "Settings":
        """Defaults when the file is absent; YAML is read only if PyYAML is there."""
        if not path or not os.path.exists(path):
            return cls()
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading YAML settings needs the optional package PyYAML") from exc
        with open(path, encoding="utf-8") as handle:
            return cls.overlay(yaml.safe_load(handle) or {})

    @classmethod
    def from_env(cls, prefix: str = "QUILL_") -> "Settings":
        """Overlay from environment variables such as ``QUILL_TOP_K``."""
        found: dict[str, Any] = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = type(getattr(cls(), f.name))
            found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return cls.overlay(found)
