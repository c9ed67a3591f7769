"""Windows that count rows instead of time.

Rows have no order of their own in a DataFrame, so every operator takes the columns that order
them, or an index column that already numbers them without holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.session import dealt, parts_for

INDEX = "row_index"
BLOCK_ROWS = 1 << 13
#: Rows of a sample for each range that is cut.
SAMPLED = 64
#: Metadata of an index column: how many rows were numbered.
ROWS = "numbered_rows"
#: Rows of a range that a task sorts.
RANGE_ROWS = 1 << 19


def splitters(df: DataFrame, keys: list[Column], ranges: int, total: int | None = None) -> list[tuple]:
    """Keys that cut ``df`` into about ``ranges`` even ranges, in rising order.

    They are quantiles of a sample that a hash of the key draws, about ``SAMPLED`` rows for each range, so
    the driver holds a bounded number of keys and a repeated call finds the same ones.
    """
    keyed = df.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("k")).withColumn("h", F.xxhash64("k"))
    total = keyed.count() if total is None else total
    share = max(1, total // (SAMPLED * ranges))
    sample = sorted((r["k"] for r in keyed.where(F.pmod("h", F.lit(share)) == 0).select("k").collect()), key=_nulls_first)
    distinct = list(dict.fromkeys(sample[len(sample) * i // ranges] for i in range(1, ranges))) if sample else []
    return [tuple(k) for k in distinct]


def _nulls_first(key):
    # Spark's order: nulls first, NaN above all numbers.
    return [(0, 0, 0) if v is None else (2, 0, 0) if v != v else (1, v, 0) for v in key]


def _range_of(keys: list[str], cuts: list[tuple], schema: T.StructType) -> Column:
    """How many splitters are at most a row's key, by bisection."""
    if not cuts:
        return F.lit(0)
    kinds = [schema[k].dataType if k in schema.names else T.LongType() for k in keys]
    fixed = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, cut, kinds, strict=True)]) for cut in cuts])
    key = F.struct(*[F.col(k).alias(k) for k in keys])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    place = lambda own: F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(cuts)) & (F.get(fixed, at + step - 1) <= own), at + step).otherwise(at))
    # The key of a row, with its hash, is built once and not again in every step.
    return F.get(F.transform(F.array(key), place), F.lit(0))


def in_ranges(df: DataFrame, order: list[str], ties: list[str] | None = None, ranges: int | None = None):
    """Rows with the range of the order they fall into (``_range``) and a hash of the ``ties`` (all columns, if none are
    named) that breaks ties of the order (``_tie``); also the number of partitions for them, if it is more than the
    session's, and of rows."""
    total = df.count()
    parts = None if ranges else parts_for(df, total, RANGE_ROWS)
    ranges = ranges or parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in ties or df.columns])
    cuts = splitters(df, [*[F.col(c) for c in order], tie], ranges, total)
    return df.withColumn("_tie", tie).withColumn("_range", _range_of([*order, "_tie"], cuts, df.schema)), parts, total


def sorted_ranges(placed: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    """Rows of :func:`in_ranges` with each range whole in a task and in order there."""
    dealt_out = placed.repartition(parts, "_range") if parts else placed.repartition("_range")
    return dealt_out.sortWithinPartitions("_range", *order, "_tie")


def number_rows(df: DataFrame, order: list[str], index: str = INDEX, ranges: int | None = None) -> DataFrame:
    """Number the rows 0, 1, 2, ... along the order columns, without sorting in one task and without a copy.

    Splitters found once cut the order into ranges; a first pass counts the rows of each range, a second numbers them inside
    their range and adds the counts of those before. Both passes derive the range from the row and the fixed splitters
    alone, so they agree whenever and wherever a task runs. A hash of the whole row breaks ties, so that many rows
    of one order are cut, too; only rows that are equal in every column stay in one range.
    """
    placed, parts, total = in_ranges(df, order, ranges=ranges)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy("_range").orderBy(*order, "_tie")
    # One row per range on the broadcast side.
    return (
        dealt(placed, parts, "_range").withColumn("_nth", F.row_number().over(own)).join(F.broadcast(offsets), "_range")
        .withColumn(index, (F.col("_offset") + F.col("_nth") - 1).alias(index, metadata={ROWS: total}))
        .drop("_tie", "_range", "_nth", "_offset")
    )


def spread(df: DataFrame, by: str, task_rows: int, index: str = INDEX) -> DataFrame:
    """Numbered rows dealt by a column, so that a task gets about ``task_rows`` of them however many there are. How many
    there are is known of an index by :func:`number_rows`; others are left as they are."""
    total = df.schema[index].metadata.get(ROWS)
    return df if total is None else dealt(df, parts_for(df, total, task_rows), by)


def numbered(df: DataFrame, order: list[str] | None, index: str = INDEX) -> DataFrame:
    return number_rows(df, order, index) if order else df


def tumbling_rows(df: DataFrame, n: int, order: list[str] | None = None, index: str = INDEX) -> DataFrame:
    """Add ``window_id``: consecutive windows of n rows, the last may be short."""
    return numbered(df, order, index).withColumn("window_id", F.expr(f"{index} div {n}"))


def overlapping_blocks(df: DataFrame, n: int, index: str = INDEX, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut rows into blocks that each also hold the n - 1 rows before them.

    Adds ``block`` and ``own``, false for the borrowed rows.
    """
    size = max(block_rows, n)
    home = F.expr(f"{index} div {size}")
    tail = F.expr(f"{index} % {size} >= {size - (n - 1)}")
    here = F.struct(home.alias("block"), F.lit(True).alias("own"))
    ahead = F.struct((home + 1).alias("block"), F.lit(False).alias("own"))
    placed = df.withColumn("_at", F.explode(F.when(tail, F.array(here, ahead)).otherwise(F.array(here))))
    return placed.select(*df.columns, "_at.block", "_at.own")


def sliding_rows(
    df: DataFrame, n: int, columns: list[str], order: list[str] | None = None, index: str = INDEX,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every run of n consecutive rows: one row per run, numbered by its first row, with the
    values of each column as an array. Fewer than n rows give no run."""
    rows = numbered(df, order, index).select(index, *columns)
    frame = Window.partitionBy("block").orderBy(index).rowsBetween(-(n - 1), 0)
    runs = overlapping_blocks(rows, n, index, block_rows).select(
        (F.col(index) - (n - 1)).alias("window_start"), "own",
        *[F.collect_list(c).over(frame).alias(c) for c in columns],
    )
    # The first n - 1 rows of all see a short frame; borrowed rows belong to the block before.
    return runs.where(F.col("own") & (F.col("window_start") >= 0)).drop("own")
