"""Matching a stream of lines against a trained model: templates are frozen, so it is stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import mining


def append_matched(stream: DataFrame, model: mining.Model, path: str, checkpoint: str):
    """Starts a query that appends matched lines (and failed ones, by eid) to a Parquet folder, a
    partition `batch` for each micro-batch: one that is tried again replaces what it wrote.

    stream has file, line_no and raw; every micro-batch is matched like a table."""

    def batch(df: DataFrame, number: int) -> None:
        mining.gated(mining.match(df, model)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
