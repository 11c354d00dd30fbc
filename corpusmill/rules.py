"""Thresholds of the evaluation, as one frozen object whose values become literals in the plans."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    weak: float = 0.28
    strong: float = 0.35
    independent_sources: int = 2
    convergence: int = 3
    evolution_step: float = 5.0
    evidences: int = 10
    top_k: int = 8
    per_document: int = 3
    rrf_k: int = 60
    documented_ratio: float = 0.5
    ambiguity: float = 1.0
    high_score: float = 60.0
    low_score: float = 40.0
    high_note: float = 2.0
    low_note: float = 1.0
    poor_confidence: float = 0.5
    #: Criterion to its own rule and the least score that it takes.
    criterion_rules: dict[int, tuple[str, float]] = field(default_factory=lambda: {2: ("ALERT-03", 50.0), 3: ("ALERT-04", 40.0), 4: ("ALERT-05", 50.0)})
    weak_score: float = 80.0
    weak_note: float = 2.4
    items_per_section: int = 3
    actions: int = 6
    reason_chars: int = 120
    limits_from: int = 2
    margin_lines: int = 3
    margin_pages: int = 3
    margin_chars: int = 150
    segment_target: int = 512
    segment_max: int = 1024
    segment_min: int = 128
    segment_overlap: int = 64


DEFAULT = Rules()
