"""Frozen, validated configuration for watermarks, windows and window aggregation.

Durations are integers in the unit of the event-time column (milliseconds for
``ts_ms``). All checks happen at construction, before any Spark job is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field

FIRE = "FIRE"
FIRE_AND_PURGE = "FIRE_AND_PURGE"

# Fixed values of the int64 event-time domain.
LONG_MIN = -(2**63)
LONG_MAX = 2**63 - 1

STRATEGIES = ("key", "global", "column")


@dataclass(frozen=True)
class WatermarkSpec:
    """Bounded-out-of-orderness watermark: max event time seen so far minus ``bound``.

    strategy ``key``: one watermark per key, moved only by that key's rows.
    strategy ``global``: one watermark over all rows in arrival order.
    strategy ``column``: watermarks are given as marker rows (``marker`` column
    not NULL) interleaved with the data in arrival order.
    """

    strategy: str = "key"
    bound: int = 0
    marker: str | None = None

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown watermark strategy {self.strategy!r}; use one of {STRATEGIES}")
        if self.bound < 0:
            raise ValueError(f"the out-of-orderness bound cannot be negative: {self.bound}")
        if self.strategy == "column" and not self.marker:
            raise ValueError("strategy 'column' needs the name of the watermark marker column")


@dataclass(frozen=True)
class WindowSpec:
    """Event-time window assigner: tumbling (slide == size) or sliding.

    ``slide > size`` is a sampling window: rows between windows belong to none.
    Only event-time tumbling/sliding windows exist; session, global and
    processing-time assigners are rejected.
    """

    size: int
    slide: int | None = None
    offset: int = 0
    kind: str = "event_time"

    def __post_init__(self):
        if self.kind != "event_time":
            raise ValueError(f"only event-time tumbling or sliding windows are supported, not {self.kind!r}")
        slide = self.size if self.slide is None else self.slide
        object.__setattr__(self, "slide", slide)
        if self.size <= 0 or slide <= 0:
            raise ValueError(f"window size and slide must be positive: size={self.size} slide={slide}")
        if abs(self.offset) >= slide:
            raise ValueError(f"window offset must satisfy abs(offset) < slide: offset={self.offset} slide={slide}")

    @property
    def tumbling(self) -> bool:
        return self.slide == self.size

    @classmethod
    def tumbling_of(cls, size: int, offset: int = 0) -> "WindowSpec":
        return cls(size=size, slide=size, offset=offset)

    @classmethod
    def sliding_of(cls, size: int, slide: int, offset: int = 0) -> "WindowSpec":
        return cls(size=size, slide=slide, offset=offset)


@dataclass(frozen=True)
class WindowAggSpec:
    """Window aggregation under a watermark.

    lateness: window keeps accepting rows while ``wm < max_ts + lateness``.
    trigger: FIRE keeps state after a firing (late refires are cumulative);
    FIRE_AND_PURGE clears it (each late refire is that row alone).
    side_output: late rows go to the side output instead of the drop counter.
    flush: fire windows still pending at the end of bounded input. Defaults to
    False for per-key and explicit watermarks, True for the global one.
    """

    window: WindowSpec
    watermark: WatermarkSpec = field(default_factory=WatermarkSpec)
    lateness: int = 0
    trigger: str = FIRE
    side_output: bool = False
    flush: bool | None = None

    def __post_init__(self):
        if self.lateness < 0:
            raise ValueError(f"the allowed lateness cannot be negative: {self.lateness}")
        if self.trigger not in (FIRE, FIRE_AND_PURGE):
            raise ValueError(f"unsupported trigger mode {self.trigger!r}; use FIRE or FIRE_AND_PURGE")
        if self.flush is None:
            object.__setattr__(self, "flush", self.watermark.strategy == "global")
