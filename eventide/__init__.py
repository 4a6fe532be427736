"""eventide: per-key and global event-time watermarking on Spark DataFrames.

Batch jobs use the closed form of the window operator (watermarks, window
classification and firing expressed as Spark window functions, aggregates and
joins); streaming jobs run the same batch operator per micro-batch with carried state.
See README.md for the module map.
"""

__version__ = "0.1.0"

from eventide.functions.aggregates import Accumulator, combine, count_of, spread_of, sum_of  # noqa: E402,F401
from eventide.operators.late import compare_watermarks, late_split  # noqa: E402,F401
from eventide.operators.watermark import (  # noqa: E402,F401
    key_watermark_snapshot,
    watermark_range,
    with_watermarks,
)
from eventide.operators.window_agg import Carry, WindowAggResult, windowed_agg  # noqa: E402,F401
from eventide.operators.windows import assign_windows, gap_rows  # noqa: E402,F401
from eventide.plans.spec import (  # noqa: E402,F401
    FIRE,
    FIRE_AND_PURGE,
    WatermarkSpec,
    WindowAggSpec,
    WindowSpec,
)
