from preftable.sources.readers import (  # noqa: F401
    RAW_SCHEMA,
    read_json_dir,
    read_parquet_table,
    read_split_files,
    read_text_dir,
    resolve_source,
    union_datasets,
)
from preftable.sources.sinks import materialise, prune_raw_columns, read_rollouts, write_metrics, write_rollouts  # noqa: F401
