"""Business rules as data.

The numbers below are fixed values: they must equal the ones the original
rate-optimisation job uses, so that results agree.  Segment names are neutral
placeholders; callers pass their own names in ``Band`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Band:
    """Allowed rate range for one subsegment; rows outside are removed.

    Bounds are kept (strict comparisons remove only rates below ``lo`` or above
    ``hi``).  ``None`` means no bound on that side.
    """

    subsegment: str
    lo: float | None
    hi: float | None


# ---------------------------------------------------------------------------
# Fixed values (must equal the original job's parameters)
# ---------------------------------------------------------------------------

# Iteration caps: segment k keeps steps with abs(iter) <= 9 - k, k = 1..7.
DEFAULT_CAPS: tuple[tuple[int, int], ...] = (
    (1, 8),
    (2, 7),
    (3, 6),
    (4, 5),
    (5, 4),
    (6, 3),
    (7, 2),
)

# Global rate ceiling applied to lead rows in portfolio summaries.
LEAD_RATE_CEILING = 0.959

# Minimum risk score kept by the multi-indicator pipeline.
MIN_RISK_SCORE = 360

# Amount buckets: half-open ranges [previous upper, upper); amounts at or above
# the last upper bound, and null amounts, fall in the open last bucket.
AMOUNT_BUCKETS: tuple[tuple[float | None, str], ...] = (
    (5000.0, "1.[-;5k>"),
    (8000.0, "2.[5k;8k>"),
    (12000.0, "3.[8k;12k>"),
    (18000.0, "4.[12k;18k>"),
    (30000.0, "5.[18k;30k>"),
    (50000.0, "6.[30k;50k>"),
    (80000.0, "7.[50k;80k>"),
    (120000.0, "8.[80k;120k>"),
    (None, "9.[120k;+>"),
)

# Exponent sweep 0.5, 1.0, ..., 9.5 (19 values).
SWEEP_EXPONENTS: tuple[float, ...] = tuple(0.5 * k for k in range(1, 20))

# Number of equal-width bins of the rate-change histogram.
HISTOGRAM_BINS = 60

# Scale of the decimal used for tolerant equality of scores.
TIE_DECIMAL = "decimal(32,10)"
