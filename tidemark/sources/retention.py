"""Which commits of the change log may go."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Retention:
    """Optional limits; a limit may overtake consumers, which then have to be rebuilt."""

    max_bytes: int | None = None
    max_age_ms: int | None = None
    max_lag: int | None = None


@dataclass(frozen=True)
class Segment:
    seq: int
    size: int
    wall_ms: int


def prunable(segments: list[Segment], consumed: int | None, head: int, now_ms: int, limits: Retention = Retention()) -> list[int]:
    """Commits to drop, oldest first: those every consumer has passed (``consumed`` is the
    least of their cursors, None without consumers), and those beyond a limit.  The newest
    segment always stays."""
    ordered = sorted(segments, key=lambda s: s.seq)
    kept = sum(s.size for s in ordered)
    out = []
    for s in ordered[:-1]:
        over = (
            (consumed is not None and s.seq <= consumed)
            or (limits.max_bytes is not None and kept > limits.max_bytes)
            or (limits.max_age_ms is not None and now_ms - s.wall_ms > limits.max_age_ms)
            or (limits.max_lag is not None and head - s.seq > limits.max_lag)
        )
        if not over:
            break  # the log goes from its old end only
        out.append(s.seq)
        kept -= s.size
    return out
