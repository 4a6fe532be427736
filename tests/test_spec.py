"""Argument validation."""

import pytest

from eventide.plans.spec import WatermarkSpec, WindowAggSpec, WindowSpec


def test_negative_bound_rejected():
    with pytest.raises(ValueError, match="cannot be negative"):
        WatermarkSpec("key", -1)


def test_unknown_strategy_and_missing_marker():
    with pytest.raises(ValueError):
        WatermarkSpec("processing", 0)
    with pytest.raises(ValueError, match="marker"):
        WatermarkSpec("column")


def test_window_assigner_checks():
    with pytest.raises(ValueError):
        WindowSpec(0)
    with pytest.raises(ValueError):
        WindowSpec(1000, 0)
    with pytest.raises(ValueError, match="offset"):
        WindowSpec(1000, 1000, 1000)
    with pytest.raises(ValueError, match="event-time"):
        WindowSpec(1000, kind="session")
    assert WindowSpec(1000).slide == 1000 and WindowSpec(1000).tumbling
    assert WindowSpec.sliding_of(3000, 1000).slide == 1000


def test_window_agg_checks():
    w = WindowSpec(1000)
    with pytest.raises(ValueError, match="lateness"):
        WindowAggSpec(w, lateness=-1)
    with pytest.raises(ValueError, match="trigger"):
        WindowAggSpec(w, trigger="PURGE")
    assert WindowAggSpec(w).flush is False
    assert WindowAggSpec(w, WatermarkSpec("global", 5)).flush is True
