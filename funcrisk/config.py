"""Settings shared by the jobs; every operator also takes them as plain arguments."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # Limits cut data and are off unless a caller sets them.
    max_functions: int | None = None
    snippet_context: int = 8
    threshold: float = 0.7
    cwe_boost: float = 0.3
    max_findings: int | None = None
    validation_split: float = 0.2
    seed: int = 42
    fn_cost_multiplier: float = 5.0
    scale_pos_weight: float | None = None
    model_kind: str = "boosted"
    model_params: dict = field(default_factory=dict)
    answer_provider: str = "ollama"
    answer_model: str = "llama3.2"
