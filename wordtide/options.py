"""Defaults of the commands, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    """The defaults of a report."""

    recent_days: int = 7
    baseline_days: int = 14
    history_days: int = 90
    top: int = 8
    min_count: int = 10
    min_ratio: float = 2.0
    max_uses: int = 50
    min_uses: int = 5
    threshold: float = 0.97
    min_clean: float = 0.4
    min_clean_chronic: float = 0.5
    fallback_clean: float = 0.3
    fallback_rungs: int = 2
    chronic_top: int = 4
    marked_top: int = 6
    min_chronic_rate: float = 0.2
    min_projects: int = 3
    frame_floor: float = 0.25
    rarity_floor: float = 10.5
    rarity_bytes: int = 4
    incongruity_floor: float = 0.85
    phrase_top: int = 4
    phrase_min: int = 5
    spark_weeks: int = 8

    def but(self, **changes) -> Options:
        return replace(self, **changes)


REPORT = Options()
SCAN = Options(top=25, min_count=5)
VET = Options(min_uses=3, top=12)
