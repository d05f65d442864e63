"""Column expressions (JVM-side, no Python UDFs)."""

from rategrid.functions.columns import (  # noqa: F401
    bucket_label,
    dec,
    dec_equal,
    fill_zero,
    nan_to_zero,
    nansum,
    nansum_or_zero,
    ratio,
    weighted_mean,
)
