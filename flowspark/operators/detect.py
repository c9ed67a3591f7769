"""Two anomaly detectors: a band around each feature's mean, and entropy over row windows."""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators import histograms, rows
from flowspark.operators.histograms import EPSILON_DIGITS


#: Rows of windows or blocks in a task, which sorts a cell for each of their features.
TASK_ROWS = 1 << 18
#: Runs of rows whose entropies are counted at once, by feature.
RUNS = 1 << 14
#: Counts that a task holds before it passes them on.
MOST_COUNTS = 1 << 18


def outside(features: list[Column], lower: list[float], upper: list[float]) -> Column:
    """1.0 where any feature lies strictly outside its limits, else 0.0."""
    hit = F.lit(False)
    for x, low, high in zip(features, lower, upper, strict=True):
        # Spark orders NaN above all numbers; a NaN is not outside.
        hit = hit | (~F.isnan(x) & ((x < low) | (x > high)))
    return F.when(hit, 1.0).otherwise(0.0)


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per feature with its mean and sample variance, from one aggregation."""
    stats = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("variance", F.var_samp))])
    parts = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_mean").alias("mean"),
                      F.col(f"{c}_variance").alias("variance")) for c in columns]
    return stats.select(F.inline(F.array(*parts)))


def mean_variance_limits(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """One row per feature: mean -/+ threshold * variance."""
    width = F.col("variance") * threshold
    return feature_summary(df, columns).select(
        "feature", (F.col("mean") - width).alias("lower"), (F.col("mean") + width).alias("upper"))


class _Threshold(Params):
    threshold = Param(Params._dummy(), "threshold", "width of the accepted band (>= 0)", TypeConverters.toFloat)

    def getThreshold(self):
        return self.getOrDefault(self.threshold)

    def setThreshold(self, value):
        if value < 0:
            raise ValueError("threshold must not be negative")
        return self._set(threshold=value)


class _Limits(Params):
    """Fitted limits; kept as params so that models copy and save like any other."""

    lower = Param(Params._dummy(), "lower", "lower limits", TypeConverters.toListFloat)
    upper = Param(Params._dummy(), "upper", "upper limits", TypeConverters.toListFloat)

    @property
    def limits(self) -> tuple[list[float], list[float]]:
        return self.getOrDefault(self.lower), self.getOrDefault(self.upper)

    @property
    def numFeatures(self) -> int:
        return len(self.getOrDefault(self.lower))

    def _features(self, name: str) -> list[Column]:
        return [F.get(F.col(name), F.lit(i)) for i in range(self.numFeatures)]


class MeanVarianceClassifier(
    Estimator, _Threshold, HasFeaturesCol, HasLabelCol, HasPredictionCol,
    DefaultParamsReadable, DefaultParamsWritable,
):
    """Limits per feature at mean -/+ threshold * variance of the (legitimate) training rows."""

    def __init__(self, threshold=2.0, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)
        self.setThreshold(threshold)

    def _fit(self, dataset: DataFrame) -> "MeanVarianceModel":
        features = F.col(self.getFeaturesCol())
        row = dataset.select(Summarizer.metrics("mean", "variance").summary(features).alias("s")).select("s.*").first()
        width = row["variance"].toArray() * self.getThreshold()
        model = MeanVarianceModel((row["mean"].toArray() - width).tolist(), (row["mean"].toArray() + width).tolist())
        return self._copyValues(model)


    def leave_out_limits(self, dataset: DataFrame, fold: str, folds: int, param_maps: list[dict]) -> list[list[tuple]]:
        """[fold][parameter point] -> (lower, upper) as fitted on all rows but the fold's.

        One scan takes count, mean and squared deviations of each fold; those of the others are merged for each fold, not
        subtracted from the whole, so nothing cancels. Points differ in what they do with the same moments.
        """
        summary = Summarizer.metrics("count", "mean", "variance").summary(F.col(self.getFeaturesCol()))
        parts = {r["fold"]: (r["s"]["count"], r["s"]["mean"].toArray(), r["s"]["variance"].toArray() * (r["s"]["count"] - 1))
                 for r in dataset.groupBy(F.col(fold).alias("fold")).agg(summary.alias("s")).collect()}
        out = []
        for left_out in range(folds):
            n, mean, squares = 0, 0.0, 0.0
            for other in sorted(parts):
                if other != left_out:
                    m, at, off = parts[other]
                    step = at - mean
                    squares = squares + off + step * step * n * m / (n + m)
                    mean, n = mean + step * m / (n + m), n + m
            if n == 0:
                raise ValueError(f"fold {left_out} leaves no rows to train on")
            variance = np.maximum(squares, 0) / (n - 1) if n > 1 else np.zeros_like(mean)
            widths = [variance * self.copy(params).getThreshold() for params in param_maps]
            out.append([((mean - w).tolist(), (mean + w).tolist()) for w in widths])
        return out


class MeanVarianceModel(
    Model, _Limits, _Threshold, HasFeaturesCol, HasLabelCol, HasPredictionCol,
    DefaultParamsReadable, DefaultParamsWritable,
):
    def __init__(self, lower=(), upper=()):
        super().__init__()
        if len(lower) != len(upper):
            raise ValueError("lower and upper limits must have the same length")
        self._set(lower=list(lower), upper=list(upper))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = dataset.withColumn("_values", vector_to_array(self.getFeaturesCol()))
        verdict = outside(self._features("_values"), *self.limits)
        return values.withColumn(self.getPredictionCol(), verdict).drop("_values")


class _EntropyParams(_Threshold, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    numRanges = Param(Params._dummy(), "numRanges", "histogram ranges (>= 1)", TypeConverters.toInt)
    windowSize = Param(Params._dummy(), "windowSize", "rows per window (>= 1)", TypeConverters.toInt)
    orderCols = Param(Params._dummy(), "orderCols", "columns that order the rows", TypeConverters.toListString)
    numFeatures_ = Param(Params._dummy(), "numFeatures_", "number of features (>= 1)", TypeConverters.toInt)

    def _at_least_one(self, **values):
        for name, value in values.items():
            if value < 1:
                raise ValueError(f"{name} must be at least 1")
        return self._set(**values)


def _extremes(op, values: np.ndarray, n: int) -> np.ndarray:
    """The least or greatest of every run of n values, from runs of twice the length each time."""
    width = 1
    while 2 * width <= n:
        values, width = op(values[:-width], values[width:]), 2 * width
    return op(values[:len(values) - (n - width)], values[n - width:]) if width < n else values


def _window_entropies(kth: list[np.ndarray], low: np.ndarray, high: np.ndarray, n: int, num_ranges: int) -> np.ndarray:
    """Entropies of windows, given the first, second, ... values of all of them and their ranges. A window that has no
    finite range counts as one bucket."""
    with np.errstate(invalid="ignore", over="ignore"):
        span = high - low
        span[span == 0] = 1.0
        # How many values of a window lie in bucket t + 1 or above: buckets are counted by comparing, in narrow numbers.
        above = np.zeros((num_ranges, len(low)), np.uint8 if len(kth) < 256 else np.int64)
        place, hit = np.empty(len(low)), np.empty(len(low), bool)
        for values in kth:
            np.subtract(values, low, out=place)
            np.divide(place, span, out=place)
            np.multiply(place, num_ranges, out=place)
            for t in range(num_ranges):
                np.greater_equal(place, t + 1, out=hit)
                above[t] += hit.view(np.uint8)
    share = np.arange(len(kth) + 1) / n
    parts = share * np.log2(np.where(share > 0, share, 1.0))
    total, before = np.zeros(len(low)), np.full(len(low), len(kth), above.dtype)
    for t in range(num_ranges):
        total -= parts[before - above[t]]
        before = above[t]
    return np.round(total - parts[before], EPSILON_DIGITS) + 0.0


def run_entropies(values: np.ndarray, n: int, num_ranges: int) -> np.ndarray:
    """Entropy of every run of n consecutive rows, one column per feature.

    Each run has a histogram over its own range, so nothing carries over from run to run; but all
    runs of a slice are counted at once, value by value.
    """
    runs = len(values) - n + 1
    out = np.empty((runs, values.shape[1]))
    for f in range(values.shape[1]):
        column = np.ascontiguousarray(values[:, f], np.float64)
        for start in range(0, runs, RUNS):
            size = min(RUNS, runs - start)
            part = column[start:start + size + n - 1]
            out[start:start + size, f] = _window_entropies(
                [part[k:k + size] for k in range(n)], _extremes(np.minimum, part, n), _extremes(np.maximum, part, n), n, num_ranges)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Feature arrays as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("features must be vectors of one length")
    return values.reshape(len(column), -1)


def _cuts(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of rows that are equal in these columns."""
    differs = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    ends = [*(np.flatnonzero(differs) + 1).tolist(), len(columns[0])]
    return list(zip([0, *ends], ends, strict=False))


_FOUND = pa.schema([("left_out", pa.int32()), ("feature", pa.int32()), ("entropy", pa.float64()), ("windows", pa.int64()),
                    ("range", pa.int32()), ("head", pa.list_(pa.float64())), ("tail", pa.list_(pa.float64()))])
_COUNTS = "left_out int, feature int, entropy double, windows bigint"


def _tally(counts: dict, left_out: int, entropies: np.ndarray) -> None:
    for f in range(entropies.shape[1]):
        of = counts.setdefault((left_out, f), {})
        for value, n in zip(*(x.tolist() for x in np.unique(entropies[:, f], return_counts=True)), strict=True):
            of[value] = of.get(value, 0) + n


def _leave_out_fn(n: int, num_ranges: int, folds: int):
    """mapInArrow function over sorted ranges (_range, _fold, _x): entropies of the runs inside each range, counted, and the rows
    at either end of each range (the number of features in ``feature``), all for each fold left out."""

    def run(batches):
        counts, edge = {}, n - 1
        at, held, held_rows, heads, tails = None, [], 0, [], []

        def take():
            x, fold = (np.concatenate(c) for c in zip(*held, strict=True))
            for f in range(folds):
                kept = x[fold != f]
                if len(heads[f]) < edge:
                    heads[f] = np.concatenate([heads[f], kept[:edge - len(heads[f])]])
                rows_ = np.concatenate([tails[f], kept])
                if len(rows_) >= n:
                    _tally(counts, f, run_entropies(rows_, n, num_ranges))
                tails[f] = rows_[max(0, len(rows_) - edge):]

        def counted():
            rows_ = [(f, i, e, c, None, None, None) for (f, i), of in counts.items() for e, c in of.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], t.type) for k, t in enumerate(_FOUND)], schema=_FOUND)

        def edges():
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((
                list(range(folds)), [x.shape[1] for x in heads], [None] * folds, [None] * folds, [at] * folds,
                [x.ravel() for x in heads], [x.ravel() for x in tails]), _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            if not batch.num_rows:
                continue
            ranges, fold = (batch.column(i).to_numpy() for i in range(2))
            x = _matrix(batch.column(2))
            for a, b in _cuts(ranges):
                if ranges[a] != at:
                    if at is not None:
                        if held:
                            take()
                        yield edges()
                    at, held, held_rows = int(ranges[a]), [], 0
                    heads, tails = ([np.empty((0, x.shape[1]))] * folds for _ in range(2))
                held.append((x[a:b], fold[a:b]))
                held_rows += b - a
                if held_rows >= RUNS:
                    take()
                    held, held_rows = [], 0
                    if sum(map(len, counts.values())) > MOST_COUNTS:
                        yield counted()
        if at is not None:
            if held:
                take()
            yield edges()
            yield counted()

    return run


def _stitch_fn(n: int, num_ranges: int):
    """applyInArrow function over the ends of all ranges of a fold left out: entropies of the runs that lie in several ranges."""

    def stitch(ends: pa.Table) -> pa.Table:
        ends, counts, carried = ends.sort_by("range"), {}, None
        left_out = ends.column("left_out")[0].as_py()
        for d, head, tail in zip(*(ends.column(c).to_pylist() for c in ("feature", "head", "tail")), strict=True):
            head, tail = (np.array(x, np.float64).reshape(-1, d) for x in (head, tail))
            if carried is not None:
                over = np.concatenate([carried, head])
                if len(over) >= n:
                    _tally(counts, left_out, run_entropies(over, n, num_ranges))
                tail = np.concatenate([carried, tail])
            carried = tail[max(0, len(tail) - (n - 1)):]
        rows_ = [(left_out, i, e, c) for (_, i), of in counts.items() for e, c in of.items()]
        return pa.table([pa.array([r[k] for r in rows_], _FOUND.field(k).type) for k in range(4)], schema=pa.schema(list(_FOUND)[:4]))

    return stitch


@contextmanager
def leave_out_entropies(
    df: DataFrame, features: str, n: int, num_ranges: int, order: list[str], fold: str | None = None, folds: int = 1,
):
    """(left_out, feature, entropy, windows): how often each entropy occurs among all runs of n rows of what remains without
    a fold, for every fold; without folds, among all runs (``left_out`` is 0).

    The rows are put in order once for all folds. Each range of them counts the runs inside it as they stream by;
    runs over the edge of a range are counted from the n - 1 rows at its ends. Held while the context lasts.
    """
    own = F.col(fold).cast("int") if fold else F.lit(-1)
    kept = df.select(*dict.fromkeys(order), F.col(features), own.alias("_own")).where("_own IS NOT NULL")
    placed, parts, _ = rows.in_ranges(kept, order, [*dict.fromkeys([*order, features])])
    lean = placed.select("_range", "_tie", *dict.fromkeys(order), "_own", vector_to_array(features).alias("_x"))
    found = rows.sorted_ranges(lean, order, parts).select("_range", "_own", "_x").mapInArrow(
        _leave_out_fn(n, num_ranges, folds), f"{_COUNTS}, range int, head array<double>, tail array<double>").persist()
    over = found.where("range IS NOT NULL").groupBy("left_out").applyInArrow(_stitch_fn(n, num_ranges), _COUNTS)
    counted = found.where("range IS NULL").select(*over.columns).unionByName(over)
    counted = counted.groupBy("left_out", "feature", "entropy").agg(F.sum("windows").alias("windows")).persist()
    try:
        yield counted
    finally:
        counted.unpersist()
        found.unpersist()


def sliding_entropy(
    df: DataFrame, features: str, n: int, num_ranges: int, order=None, index: str = rows.INDEX,
    block_rows: int = rows.BLOCK_ROWS,
) -> DataFrame:
    """(feature, entropy, windows): how often each entropy occurs among all runs of n rows."""
    numbered = rows.numbered(df.select(*(order or [index]), F.col(features)), order, index)
    blocks = rows.overlapping_blocks(
        numbered.select(index, vector_to_array(features).alias("x")), n, index, block_rows)

    def per_block(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i")
        if len(block) < n:
            return pd.DataFrame({"feature": [], "entropy": [], "windows": []})
        entropies = run_entropies(np.stack(block["x"].to_numpy()), n, num_ranges)
        parts = []
        for f in range(entropies.shape[1]):
            found, count = np.unique(entropies[:, f], return_counts=True)
            parts.append(pd.DataFrame({"feature": f, "entropy": found, "windows": count}))
        return pd.concat(parts)

    # A block has at most block_rows + n rows, and equal entropies leave it already counted.
    blocks = rows.spread(blocks, "block", TASK_ROWS, index)
    counted = blocks.select("block", F.col(index).alias("i"), "x").groupBy("block").applyInPandas(
        per_block, "feature int, entropy double, windows bigint")
    return counted.groupBy("feature", "entropy").agg(F.sum("windows").alias("windows"))


def entropy_limits(entropies: DataFrame, num_ranges: int, threshold: float, by: tuple = ()) -> DataFrame:
    """Limits per feature: edges of the most frequent entropy bucket, widened by the threshold.

    ``entropies`` holds (feature, entropy, windows); a weight instead of repeated rows. ``by`` names columns that
    tell several such tables apart.
    """
    group = [*by, "feature"]
    ranges = entropies.groupBy(*group).agg(F.min("entropy").alias("low"), F.max("entropy").alias("high"))
    low, high = F.col("low"), F.col("high")
    position = F.floor((F.col("entropy") - low) / (high - low) * num_ranges)
    bucket = F.when(high == low, 0).otherwise(F.least(position, F.lit(num_ranges - 1))).cast("int")
    counts = (
        # One row per feature.
        entropies.join(F.broadcast(ranges), group).groupBy(*group, "low", "high", bucket.alias("bucket"))
        .agg(F.sum("windows").alias("n"))
    )
    top = counts.groupBy(*group, "low", "high").agg(
        F.max_by("bucket", F.struct(F.col("n"), -F.col("bucket"))).alias("bucket"))
    edge = lambda i: low + (i * (high - low)) / num_ranges
    closing = (F.col("bucket") == num_ranges - 1) | (high == low)
    return top.select(
        *group, (edge(F.col("bucket")) - threshold).alias("lower"),
        (F.when(closing, high).otherwise(edge(F.col("bucket") + 1)) + threshold).alias("upper"),
    )


def tumbling_entropy(
    df: DataFrame, features: str, n: int, num_ranges: int, order=None, index: str = rows.INDEX,
    label: str | None = None,
) -> DataFrame:
    """One row per window of n rows: its row range, entropy vector and greatest label."""
    label = label if label in df.columns else None
    columns = [features] + ([label] if label else [])
    kept = df.select(*dict.fromkeys([*(order or [index]), *columns]))
    windows = rows.tumbling_rows(kept, n, order, index)
    cells = (
        rows.spread(windows.repartition("window_id"), "window_id", TASK_ROWS, index)
        .select("window_id", index, *([label] if label else []),
                F.posexplode(vector_to_array(features)).alias("feature", "value"))
    )
    group = ["window_id", "feature"]
    extra = [F.min(index).alias("first_row"), F.max(index).alias("last_row"),
             *([F.max(label).alias(label)] if label else [])]
    carried = [F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"),
               *([F.max(label).alias(label)] if label else [])]
    counts = (
        histograms.with_range(cells, group, small_groups=True)
        .groupBy(*group, histograms.bucket_of(num_ranges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *extra)
    )
    per_feature = counts.groupBy(*group).agg(histograms.entropy_of(n).alias("entropy"), *carried)
    # Every window has all features, so position i of the sorted array is feature i.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("feature", "entropy"))), lambda c: c["entropy"])
    return per_feature.groupBy("window_id").agg(*carried, array_to_vector(ordered).alias(features))


_JUDGED = pa.schema([("judge", pa.int32()), ("label", pa.float64()), ("said", pa.bool_()), ("windows", pa.int64()), ("fold", pa.int32()),
                     ("window", pa.int64()), ("features", pa.int32()), ("x", pa.list_(pa.float64()))])
_JUDGED_TYPES = "judge int, label double, said boolean, windows bigint"
_NO_LABEL = float("-inf")


def _judge(counts: Counter, judges: list[tuple], entropies: np.ndarray, labels: np.ndarray) -> None:
    if np.isneginf(labels).any():
        raise ValueError("a window without a label")
    for name, lower, upper in judges:
        said = ((entropies < np.array(lower)) | (entropies > np.array(upper))).any(axis=1)
        for label, hits, n in zip(*(x.tolist() for x in _labels_and_hits(labels, said)), strict=True):
            for hit, times in ((True, hits), (False, n - hits)):
                if times:
                    counts[name, label, hit] += times


def _labels_and_hits(labels: np.ndarray, said: np.ndarray) -> tuple:
    values, of = np.unique(labels, return_inverse=True)
    return values, np.bincount(of, said, len(values)).astype(np.int64), np.bincount(of, minlength=len(values))


def _tumbling(x: np.ndarray, n: int, num_ranges: int) -> np.ndarray:
    """Entropies of windows: from (windows, rows, features) to (windows, features). Shares are of n rows."""
    out = np.empty((x.shape[0], x.shape[2]))
    for f in range(x.shape[2]):
        kth = np.ascontiguousarray(x[:, :, f].T)
        out[:, f] = _window_entropies(list(kth), kth.min(axis=0), kth.max(axis=0), n, num_ranges)
    return out


def _judged_fn(n: int, num_ranges: int, starts: dict[tuple, int], judges: dict[int, list[tuple]]):
    """mapInArrow function over sorted ranges (_range, _own, _x, _label): windows that lie inside a range and have all features, judged and
    counted; the rows of others as they are. ``starts`` has the place in its fold of the first row of a fold in a range."""

    def run(batches):
        counts, parts = Counter(), []
        at, place, x, has, labels = None, 0, None, None, None

        def part(a: int, b: int) -> None:
            parts.append((None, labels[a:b].max(), None, None, at[1], (place + a) // n, x.shape[1], x[a:b][has[a:b]].ravel()))

        def take(last: bool) -> None:
            nonlocal place, x, has, labels
            lead = -place % n
            if lead and (last or len(x) >= lead):
                part(0, min(lead, len(x)))
            elif lead:
                return
            a = min(lead, len(x))
            b = a + (len(x) - a) // n * n
            full = has[a:b].reshape(-1, n).all(axis=1)
            if full.any():
                _judge(counts, judges[at[1]], _tumbling(x[a:b].reshape(-1, n, x.shape[1])[full], n, num_ranges),
                       labels[a:b].reshape(-1, n).max(axis=1)[full])
            for i in np.flatnonzero(~full):
                part(a + i * n, a + (i + 1) * n)
            if last and b < len(x):
                part(b, len(x))
            place, x, has, labels = place + b, x[b:], has[b:], labels[b:]

        def out(rows_):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], t.type) for k, t in enumerate(_JUDGED)], schema=_JUDGED)

        for batch in batches:
            if not batch.num_rows:
                continue
            ranges, fold = (batch.column(i).to_numpy() for i in range(2))
            given = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            known = _matrix(batch.column(2).drop_null())
            values = np.zeros((batch.num_rows, known.shape[1] if given.any() else 0 if x is None else x.shape[1]))
            if given.any():
                values[given] = known
            of = pc.fill_null(batch.column(3), _NO_LABEL).to_numpy(zero_copy_only=False)
            for a, b in _cuts(ranges, fold):
                here = (int(ranges[a]), int(fold[a]))
                if here == at:
                    if x.shape[1] != values.shape[1]:  # rows without features so far
                        x = np.zeros((len(x), values.shape[1]))
                    x, has, labels = np.concatenate([x, values[a:b]]), np.concatenate([has, given[a:b]]), np.concatenate([labels, of[a:b]])
                else:
                    if at is not None:
                        take(True)
                    at, place, x, has, labels = here, starts[here], values[a:b], given[a:b], of[a:b]
                take(False)
            if parts:
                yield out(parts)
                parts.clear()
        if at is not None:
            take(True)
            yield out(parts + [(j, label, said, c, None, None, None, None) for (j, label, said), c in counts.items()])

    return run


def _judged_parts_fn(n: int, num_ranges: int, judges: dict[int, list[tuple]]):
    """applyInArrow function over a fold's rows of windows that lie in several ranges, or end early: judged and counted."""

    def run(parts: pa.Table) -> pa.Table:
        counts, fold, of = Counter(), parts.column("fold")[0].as_py(), {}
        for window, label, d, x in zip(*(parts.column(c).to_pylist() for c in ("window", "label", "features", "x")), strict=True):
            own = of.setdefault(window, [label, []])
            own[0] = label if label != label else max(own[0], label)
            if x:
                own[1].append(np.array(x).reshape(-1, d))
        for label, given in of.values():
            # A window none of whose rows has features has no entropies.
            if given:
                _judge(counts, judges[fold], _tumbling(np.concatenate(given)[None], n, num_ranges), np.array([label]))
        rows_ = [(*k, c) for k, c in counts.items()]
        return pa.table([pa.array([r[k] for r in rows_], _JUDGED.field(k).type) for k in range(4)], schema=pa.schema(list(_JUDGED)[:4]))

    return run


def judged_windows(df: DataFrame, features: str, n: int, num_ranges: int, order: list[str], label: str, fold: str | None,
                   judges: dict[int, list[tuple]]) -> list[tuple]:
    """(name, label, said, windows): how many tumbling windows of n rows of each fold, in order, with which greatest label,
    every judge (name, lower, upper) of that fold says to be outside its limits or not. Without a column of folds all
    rows are fold 0.

    The rows are put in order once for all folds; a first pass counts the rows of each fold in each range, so that windows are known
    inside a range. Only rows of windows at the edges of ranges leave it.
    """
    own = F.col(fold).cast("int") if fold else F.lit(0)
    names, along = [*dict.fromkeys([*order, features, label])], ["_own", *order]
    placed, parts, _ = rows.in_ranges(df.select(*names, own.alias("_own")).where(F.col("_own").isin(list(judges))), along, names)
    # A row per range and fold that meet.
    starts, so_far = {}, Counter()
    for r in sorted(placed.groupBy("_range", "_own").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_range"]):
        starts[r["_range"], r["_own"]] = so_far[r["_own"]]
        so_far[r["_own"]] += r["n"]
    lean = placed.select("_range", "_tie", *dict.fromkeys(along), vector_to_array(features).alias("_x"), F.col(label).cast("double").alias("_label"))
    found = rows.sorted_ranges(lean, along, parts).select("_range", "_own", "_x", "_label").mapInArrow(
        _judged_fn(n, num_ranges, starts, judges), f"{_JUDGED_TYPES}, fold int, window bigint, features int, x array<double>").persist()
    try:
        edges = found.where("judge IS NULL").groupBy("fold").applyInArrow(_judged_parts_fn(n, num_ranges, judges), _JUDGED_TYPES)
        counted = found.where("judge IS NOT NULL").select(*edges.columns).unionByName(edges)
        return [tuple(r) for r in counted.groupBy("judge", "label", "said").agg(F.sum("windows")).collect()]
    finally:
        found.unpersist()


class EntropyClassifier(Estimator, _EntropyParams, DefaultParamsReadable, DefaultParamsWritable):
    """Limits per feature around the most frequent entropy of sliding row windows."""

    def __init__(self, numFeatures=1, numRanges=5, windowSize=20, threshold=0.1, orderCols=(),
                 featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, orderCols=list(orderCols))
        self._at_least_one(numFeatures_=numFeatures, numRanges=numRanges, windowSize=windowSize)
        self.setThreshold(threshold)

    def _fit(self, dataset: DataFrame) -> "EntropyModel":
        get = self.getOrDefault
        if get("orderCols"):
            ((limits,),) = self.leave_out_limits(dataset, None, 1, [{}])
        else:
            entropies = sliding_entropy(dataset, self.getFeaturesCol(), get("windowSize"), get("numRanges")).persist()
            try:
                # One row per feature.
                limits = self._checked(entropy_limits(entropies, get("numRanges"), self.getThreshold()).orderBy("feature").collect())
            finally:
                entropies.unpersist()
        return self._copyValues(EntropyModel(*limits))

    def _checked(self, limits: list) -> tuple[list[float], list[float]]:
        if len(limits) != self.getOrDefault("numFeatures_"):
            raise ValueError(f"{len(limits)} features with windows, {self.getOrDefault('numFeatures_')} expected")
        return [r["lower"] for r in limits], [r["upper"] for r in limits]

    def alike(self, param_maps: list[dict]) -> list[list[int]]:
        """Parameter points by what they need of the rows: those of a group differ in threshold only."""
        groups: dict[tuple, list[int]] = {}
        for i, params in enumerate(param_maps):
            est = self.copy(params)
            get = est.getOrDefault
            groups.setdefault((est.getFeaturesCol(), get("windowSize"), get("numRanges"), tuple(get("orderCols"))), []).append(i)
        return list(groups.values())

    def leave_out_limits(self, dataset: DataFrame, fold: str | None, folds: int, param_maps: list[dict]) -> list[list[tuple]]:
        """[fold][parameter point] -> (lower, upper) as fitted on all rows but the fold's, the rows put in order once. Needs
        order columns."""
        out = [[None] * len(param_maps) for _ in range(folds)]
        for group in self.alike(param_maps):
            est = self.copy(param_maps[group[0]])
            get = est.getOrDefault
            with leave_out_entropies(dataset, est.getFeaturesCol(), get("windowSize"), get("numRanges"), get("orderCols"), fold, folds) as found:
                for i in group:
                    point = self.copy(param_maps[i])
                    # One row per fold and feature.
                    limits = entropy_limits(found, get("numRanges"), point.getThreshold(), ("left_out",)).orderBy("left_out", "feature").collect()
                    for f in range(folds):
                        out[f][i] = point._checked([r for r in limits if r["left_out"] == f])
        return out

    def judged(self, dataset: DataFrame, fold: str | None, judges: dict[int, list[tuple]]) -> list[tuple]:
        """(name, label, said, windows): see :func:`judged_windows`."""
        get = self.getOrDefault
        return judged_windows(dataset, self.getFeaturesCol(), get("windowSize"), get("numRanges"), get("orderCols"),
                              self.getLabelCol(), fold, judges)


class EntropyModel(Model, _Limits, _EntropyParams, DefaultParamsReadable, DefaultParamsWritable):
    """One verdict per tumbling window. ``strictReference`` compares with the lower limit on both
    sides, so that any entropy but the lower limit itself is an anomaly."""

    strictReference = Param(Params._dummy(), "strictReference", "compare with the lower limit only", TypeConverters.toBoolean)

    def __init__(self, lower=(), upper=()):
        super().__init__()
        if len(lower) != len(upper):
            raise ValueError("lower and upper limits must have the same length")
        self._set(lower=list(lower), upper=list(upper), strictReference=False)

    def setStrictReference(self, value: bool):
        return self._set(strictReference=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        windows = tumbling_entropy(
            dataset, self.getFeaturesCol(), get("windowSize"), get("numRanges"),
            get("orderCols") or None, label=self.getLabelCol())
        lower, upper = self.limits
        values = windows.withColumn("_values", vector_to_array(self.getFeaturesCol()))
        verdict = outside(self._features("_values"), lower, lower if get("strictReference") else upper)
        return values.withColumn(self.getPredictionCol(), verdict).drop("_values")
