"""Rate-grid optimisation on Spark.

A scenario grid holds, per offer key (``llave``), one row per rate step
(``iter``; 0 is the rate offered today, the "lead") with proposed rate, amount,
acceptance probability and value indicators.  The library scores the grid,
removes scenarios outside business limits, picks the best rate per key, and
compares the chosen portfolio with the lead portfolio over a range of
exponents.  Every public function maps DataFrames to DataFrames and collects
nothing to the driver.  Functions that stage intermediate tables run jobs while
they build their result; their docstrings say "Eager".
"""

from rategrid.rules import (  # noqa: F401
    AMOUNT_BUCKETS,
    DEFAULT_CAPS,
    SWEEP_EXPONENTS,
    Band,
)
from rategrid.schema import GridColumns  # noqa: F401

__all__ = [
    "AMOUNT_BUCKETS",
    "DEFAULT_CAPS",
    "SWEEP_EXPONENTS",
    "Band",
    "GridColumns",
]
