"""Batch sinks; a writer is any function of (batch DataFrame, batch id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.metrics import RUN_METRICS, metric_schema


def file_writer(path: str, fmt: str = "json", **options):
    """Writer of micro-batches to files. Each batch has its own folder, which a repeated batch
    overwrites: a batch replayed after a failure is not written twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").options(**options).format(fmt).save(f"{path}/batch={batch_id}")

    return write


def save_run_metrics(spark, runs, path: str) -> None:
    """Append one row per run (a dict of the run metrics) to a results table."""
    rows = [tuple(run.get(n) for n in RUN_METRICS) for run in runs]
    spark.createDataFrame(rows, metric_schema(RUN_METRICS)).write.mode("append").parquet(path)


def export_metrics(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A metric table (a row per run or batch) as one CSV file with a header."""
    if fmt.lower() != "csv":
        raise ValueError(f"unsupported file format {fmt!r}")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_flow_text(df: DataFrame, path: str, label: str) -> None:
    """Flows as lines of comma-separated statistics ending in the class name."""
    from flowspark.operators.codec import encode_flow_csv

    lines = encode_flow_csv(df).select(F.concat_ws(",", "value", F.lit(label)).alias("value"))
    lines.write.mode("append").text(path)
