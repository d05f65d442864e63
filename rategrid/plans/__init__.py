"""Composite plans: trade-off sweep, final selection, end-to-end pipelines."""

from rategrid.plans.tradeoff import final_selection, scenario_summary, sweep_summaries, tradeoff  # noqa: F401
from rategrid.plans.pipelines import run_multi, run_pandas_rules, run_single, write_outputs  # noqa: F401
