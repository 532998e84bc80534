"""Half-open system-time intervals; bounds are always arguments, never clock reads."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone


@dataclass(frozen=True)
class Interval:
    start: datetime
    end: datetime

    def __post_init__(self) -> None:
        if self.end <= self.start:
            raise ValueError(f"empty interval: end {self.end} is not after start {self.start}")

    @classmethod
    def year(cls, y: int) -> "Interval":
        return cls(datetime(y, 1, 1, tzinfo=timezone.utc), datetime(y + 1, 1, 1, tzinfo=timezone.utc))

    @property
    def start_iso(self) -> str:
        return self.start.isoformat()

    @property
    def end_iso(self) -> str:
        return self.end.isoformat()


def parse_interval(start: str, end: str) -> Interval:
    """ISO bounds; a bound without an offset is taken as UTC. ``end <= start`` raises ValueError."""

    def bound(text: str) -> datetime:
        t = datetime.fromisoformat(text)
        return t if t.tzinfo else t.replace(tzinfo=timezone.utc)

    return Interval(bound(start), bound(end))


def default_run_id(start: datetime) -> str:
    """The same interval always gives the same id, so reruns compare."""
    return start.astimezone(timezone.utc).strftime("manual__%Y%m%dT%H%M%SZ")
