"""Shared helpers: scratch tables, column choice, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import scratch_dir, shared_dir

#: White space of the operators: blank and \t \n \v \f \r.
SPACE = "\\x20\\x09-\\x0D"
#: Bytes of rows that a task turns into Python values at once.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, fixes what later steps refer to
    by position, and survives lost executors. ``drop_scratch`` removes such tables."""
    path = scratch_dir(df.sparkSession, f"llm-{purpose}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables below the shared folder. Call it when results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/llm-*")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path) or []:
        fs.delete(status.getPath(), True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under own names; a null text is empty."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int, most_bytes: int = 32 << 20) -> DataFrame:
    """Mark ``df`` for broadcasting if its counted rows fit; else leave the join to a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= most_bytes else df


#: A key with more than this share of the rows is hot; there are fewer such keys than this.
HOT_SHARE = 1024


def join_hot(rows: DataFrame, groups: DataFrame, on: list[str], size_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has each key once and the number of its rows in ``size_col``
    (``total`` in all). Groups with more than a 1024th of the rows, fewer than 1024, are broadcast, so their
    rows stay where they are; no other key brings more than that share to a task."""
    bound = max(total // HOT_SHARE, HOT_SHARE)
    is_hot = F.col(size_col) > bound
    hot = F.broadcast(groups.where(is_hot).withColumn("_hot", F.lit(True)))
    met = rows.join(hot, on, "left")
    names = [c for c in groups.columns if c not in on]
    here = met.where("_hot").drop("_hot")
    return here.unionByName(met.where("_hot IS NULL").drop("_hot", *names).join(groups.where(~is_hot), on))


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about so many bytes, at least a row each. A batch may be a whole partition,
    and Python values take several times its memory."""
    for batch in batches:
        rows = max(1, most_bytes * batch.num_rows // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_rows(df: DataFrame, start: Callable, schema: str, columns: dict[str, pa.DataType]) -> DataFrame:
    """``mapInArrow`` for functions over Python values: ``start()`` runs once per partition and
    returns a function from the batch's columns (lists) to the columns of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            out = step(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, columns.values(), strict=True)], list(columns))

    return df.mapInArrow(run, schema)
