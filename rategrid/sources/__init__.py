"""Sources and sinks: grid readers, typed CSV rule tables, Parquet stages."""

from rategrid.sources.io import (  # noqa: F401
    checkpoint_dir,
    drop_stages,
    export_csv,
    read_csv_table,
    read_grid,
    stage,
    stage_scope,
    write_stage,
)
from rategrid.sources.runs import (  # noqa: F401
    clean_runs,
    clean_stages,
    publish_run,
    published_runs,
    read_published,
)
