"""Window assignment vs brute force, incl. negative times, offsets, gaps and int64 edges."""

import random

import pytest

from eventide.operators.windows import assign_windows
from eventide.plans.spec import WindowSpec
from definition import LONG_MAX, windows_of


@pytest.mark.parametrize("size,slide,offset", [(1000, 1000, 0), (3000, 1000, 0), (1000, 1000, 250),
                                               (3000, 700, -300), (500, 2000, 100), (7, 3, 1)])
def test_assignment_matches_brute_force(spark, size, slide, offset):
    rng = random.Random(size * 7 + slide)
    ts = [rng.randint(-20_000, 20_000) for _ in range(300)] + [0, -1, 1, offset, offset - 1,
                                                               LONG_MAX, LONG_MAX - slide, LONG_MAX - 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id BIGINT, ts BIGINT")
    got = sorted((r.id, r.window_start, r.window_end)
                 for r in assign_windows(df, "ts", WindowSpec(size, slide, offset)).collect())
    want = sorted((i, s, e) for i, t in enumerate(ts) for s in windows_of(t, size, slide, offset) for e in [s + size])
    assert got == want
