"""Parameters of the extraction, checked before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Names that appear in results and rule files.
EXTRACTION_TYPES = (
    "Full-AlmostFull",
    "Empty-AlmostEmpty",
    "Full-Decrease",
    "Empty-Increase",
    "Full-Increase",
    "Empty-Decrease",
)
NEIGHBORHOODS = ("distance", "indegree")
TARGETS = ("AlmostFull", "AlmostEmpty")
EARTH_RADIUS_KM = 6373.0


@dataclass(frozen=True)
class MineParams:
    """All knobs of state derivation and sequence building.

    ``base_time`` anchors slot 0.  It is a constant rather than ``min(time)``
    so that numbering slots costs no pass over the readings.
    """

    extraction_type: str = "Full-AlmostFull"
    interval: int = 30
    window_size: int = 3
    th: float = 0.5
    max_delta: int = 3
    ct: int = 3
    neighborhood: str = "distance"
    n_neighbors: int = 5
    thr: int = 1
    wrap_states: bool = False
    state_change: bool = False
    for_test: bool = False
    drop_nulls: bool = False
    tot_stations: int = 35
    time_zone: str | None = None
    no_increase: bool = False
    no_decrease: bool = False
    base_time: str = "2013-08-29 12:06:00"

    def __post_init__(self) -> None:
        if self.ct < 1:
            raise ValueError("ct must be at least 1")
        if self.extraction_type not in EXTRACTION_TYPES:
            raise ValueError(f"unknown extraction type {self.extraction_type!r}")
        if self.neighborhood not in NEIGHBORHOODS:
            raise ValueError(f"unknown neighborhood {self.neighborhood!r}")
        if self.interval < 1 or self.window_size < 1:
            raise ValueError("interval and window_size must be positive")
        if self.thr < 0:
            raise ValueError("thr must not be negative")

    @property
    def side(self) -> str:
        """Critical state name: Full or Empty."""
        return self.extraction_type.split("-")[0]

    @property
    def second(self) -> str:
        """Second part of the extraction type, e.g. Decrease."""
        return self.extraction_type.split("-")[1]

    @property
    def by_reading(self) -> bool:
        """True when every reading gets a state of its own, with no trend in the slot."""
        return self.second.startswith("Almost")

    @property
    def negatives(self) -> bool:
        return self.no_increase or self.no_decrease

    def but(self, **changes) -> "MineParams":
        return replace(self, **changes)


def check_target(target: str) -> str:
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}")
    return target
