"""Stateless feature rules on streaming DataFrames.

The reference has no streams; what carries over is that every Column rule of
``tabforge.functions`` (parsers, bins with fixed edges, flags, maps, formula
scores) is a pure per-row expression, so it runs unchanged inside Structured
Streaming micro-batches. Fitted statistics (edges, codes, means) are computed
once on a batch table and enter the stream as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tabforge.session import ensure_checkpoint_dir


def read_parquet_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """File-source stream over a folder of parquet files (explicit schema, bounded batch size)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
                 .parquet(path))


def apply_rules(stream: DataFrame, rules: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add each named rule as a column (pure expressions: no state, no shuffle)."""
    out = stream.withColumns(rules)
    return out.select(*(keep or stream.columns), *rules) if keep is not None else out


def write_parquet_stream(stream: DataFrame, path: str, name: str, trigger_once: bool = True):
    """Exactly-once parquet sink; progress is kept under the shared checkpoint folder."""
    spark = stream.sparkSession
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = stream.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", path)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
