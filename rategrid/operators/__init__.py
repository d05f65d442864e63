"""DataFrame -> DataFrame operators on the scenario grid."""

from rategrid.operators.factored import rate_change_histogram  # noqa: F401
from rategrid.operators.limits import (  # noqa: F401
    cap_iterations,
    enrich,
    expected,
    lead_rows,
    lead_rows_under_ceiling,
    rate_band,
    rate_floor,
    scenario,
    score_filter,
)
from rategrid.operators.prep import (  # noqa: F401
    conform,
    key_sample,
    nearest_rate,
    normalise_names,
    numbered,
    offer_lot,
    preview,
    sort_scenarios,
    top_offer,
)
from rategrid.operators.rule_tables import (  # noqa: F401
    bucket_label_table,
    bucket_report_table,
    interval_join,
    rate_band_table,
)
from rategrid.operators.selection import (  # noqa: F401
    best_rate,
    chosen_rows,
    fill_numeric,
    key_stats,
    lead_pivots,
    objective,
    objective_pandas_fill,
    pick_rates,
    rate_groups,
    score,
    sweep_picks,
    unpivot_picks,
    upper_envelope,
)
from rategrid.operators.skew import HotKeys, Keyed, hot_keys, key_join, keyed_stage  # noqa: F401
from rategrid.operators.summary import (  # noqa: F401
    bucket_report,
    compare,
    histogram,
    lead_summary_pandas,
    merge_profiles,
    portfolio,
    profile,
    profile_sketch,
    rate_change,
    rate_change_groups,
    read_profile,
)
