"""Structured Streaming operators (§2.10).

``stream_prepare`` runs the preparation transforms as one stateless streaming plan into one Parquet
sink: normalising, rendering and the sequence builders work inside a row; encoding
(``operators.encode.encode_stream``) joins the tokens to the vocabulary table and folds them under a name
of each row's own inside the micro-batch, so records that share an id stay apart. The file sink's log
commits each micro-batch once, also when it is retried.

``stream_step_metrics`` averages step-log rows over tumbling event-time windows with a watermark,
in append mode: a window is emitted once the watermark passes its end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_prepare(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    out_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Apply a row-wise ``transform`` to a stream and append its rows to a Parquet table at ``out_path``."""
    return (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_step_metrics(
    stream: DataFrame,
    ts_col: str,
    metric_cols: Sequence[str],
    window: str = "1 hour",
    *,
    watermark: str,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Tumbling-window means of the metric columns, for an append-mode sink; rows later than ``watermark`` are left out."""
    return (
        stream.withWatermark(ts_col, watermark)
        .groupBy(F.window(ts_col, window).alias("w"), *group_cols)
        .agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in metric_cols])
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *group_cols,
            "n_rows",
            *metric_cols,
        )
    )


def run_available(df: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Run a streaming DataFrame over all available input into ``out_path`` (append mode)."""
    q = (
        df.writeStream.format(fmt)
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
