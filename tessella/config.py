"""Settings of the retrieval pipeline, with the defaults that all stages share."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    per_source: int = 10
    fused: int = 10
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class RerankConfig:
    model_window: int = 512
    special_tokens: int = 3
    safety: int = 50
    overlap: int = 50
    most_query_tokens: int = 150
    temperature: float = 4.0
    gate: float = 0.45
    context_tokens: int = 3500


@dataclass(frozen=True)
class FaithfulnessConfig:
    most_claims: int = 8
    least_words: int = 3
    threshold: float = 0.50


@dataclass(frozen=True)
class TierConfig:
    reranker_weight: float = 0.7
    faithfulness_weight: float = 0.3
    high: float = 0.70
    moderate: float = 0.50
    low: float = 0.20

    def __post_init__(self):
        if abs(self.reranker_weight + self.faithfulness_weight - 1) > 0.001:
            raise ValueError("the weights have to add up to 1")
