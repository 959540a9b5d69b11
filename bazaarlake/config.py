"""Thresholds of the retail jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    min_age: int = 16
    max_age: int = 100
    min_rating: float = 1.0
    max_rating: float = 5.0
    window_seconds: int = 604_800
    active_days: int = 5
    outlier_factor: float = 3.0
    burst_seconds: int = 300
    suspicion_score: int = 2


LIMITS = Limits()
