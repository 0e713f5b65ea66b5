from preftable.streaming.streams import run_available, stream_prepare, stream_step_metrics  # noqa: F401
