"""Whitening of embeddings: a weighted covariance over distinct vectors, each of them whitened once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows that one distinct vector is sent to together; a vector that fills the table goes to that many blocks fewer rows.
BLOCK_ROWS = 1 << 16
#: Entries are bounded, so that sums of their products fit 38 digits.
LIMIT = 1 << 34
#: An eigenvalue below this share of the trace is no direction in which the vectors differ.
FLAT = 1e-12
#: Multiplied at a time.
GEMM_ROWS = 4096


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is complete and finite; x = floor(64 * c) + 1000000. Entries beyond
    +-LIMIT count as +-LIMIT."""
    entries = F.col("c")
    whole = F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    limit = float(LIMIT)
    x = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(limit)), F.lit(-limit)) * SCALE).cast("long") + SHIFT)
    return vectors.where(whole).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("c")).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists as a matrix; list columns are sliced by their offsets."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


@dataclass
class Fit:
    """The fit over ``n`` (weighted) vectors: sums S, eigenvalues e by falling size, eigenvectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sums per dimension of rows (x, weight)."""
    parts = distinct.select("weight", F.posexplode("x").alias("dim", "value")).groupBy("dim").agg(
        F.sum("weight").alias("n"), F.sum(F.col("value").cast("decimal(38,0)") * F.col("weight")).alias("sum")).orderBy("dim").collect()
    return (parts[0]["n"] if parts else 0), [int(p["sum"]) for p in parts]


def _products(distinct: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Exact sums of weight * (x - centre) (x - centre)^T, a matrix product per few thousand rows. Entries are integers: products
    in doubles are exact as long as they stay below 2^53, which is checked, so the result does not depend on
    how rows are dealt."""
    d = len(centre)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            for at in range(0, batch.num_rows, GEMM_ROWS):
                some = batch.slice(at, GEMM_ROWS)
                y, weight = _matrix(some.column(0)) - centre, some.column(1).to_numpy()
                bound = int(np.abs(y).max(initial=0)) ** 2 * int(weight.sum())
                if bound < 1 << 53:
                    y = y.astype(float)
                    total += ((y * weight[:, None]).T @ y).astype(np.int64)
                else:
                    y = y.astype(object)
                    total += (y * weight.astype(object)[:, None]).T @ y
        cells = [str(v) for v in total[upper]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells, pa.string())], ["cell", "value"])

    cells = distinct.select("x", "weight").mapInArrow(run, "cell int, value string").groupBy("cell").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out = np.zeros((d, d), object)
    for c in cells:
        i, j = upper[0][c["cell"]], upper[1][c["cell"]]
        out[i, j] = out[j, i] = int(c["value"])
    return out


def fit(distinct: DataFrame) -> Fit:
    """Covariance with divisor n over rows (x, weight), and its eigenvectors."""
    n, sums = _sums(distinct)
    if not n or not sums:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    # Centred by the nearest integers; what is left of the mean, a half at most, is taken off exactly.
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([s - n * c for s, c in zip(sums, centre, strict=True)], object)
    scaled = _products(distinct, np.array(centre, np.int64)) * n - np.outer(rest, rest)
    covariance = np.array([[v / n**2 for v in row] for row in scaled.tolist()])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    # One sign for all runs: the largest entry of each is positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(sums))])
    return Fit(n, sums, values, vectors * np.where(signs == 0, 1, signs), float(np.trace(covariance)))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2; null where 64 bits are too few."""
    if not x.size:
        return [0] * len(x)
    total = np.array(sums, object)
    far = max(int(x.max()) * n - min(sums), max(sums) - int(x.min()) * n)
    if far ** 2 * x.shape[1] < 1 << 63:
        apart = x * n - total.astype(np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = x.astype(object) * n - total
    return [v if v < 1 << 63 else None for v in (apart * apart).sum(axis=1).tolist()]


def _whitened(distinct: DataFrame, found: Fit, components: int) -> DataFrame:
    """(k1, k2, deviation, whitened, weight) of each distinct vector."""
    n, sums, vectors = found.n, found.sums, found.vectors[:, :components]
    values = found.values[:components]
    usable = values > FLAT * max(found.trace, 1e-300)
    axes = vectors / np.sqrt(np.where(usable, values, np.inf))
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            white = (x - centre - rest) @ axes
            lists = [[float(v) if ok else None for v, ok in zip(row, usable, strict=True)] for row in white]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(_deviations(x, n, sums), pa.int64()),
                pa.array(lists, pa.list_(pa.float64())), batch.column(3)],
                ["k1", "k2", "deviation", "whitened", "weight"])

    return distinct.select("k1", "k2", "x", "weight").mapInArrow(
        run, "k1 long, k2 long, deviation long, whitened array<double>, weight long")


def identity_error(white: DataFrame, n: int, usable: int) -> float:
    """The largest entry of the covariance of ``whitened`` (over the fit list, centred first) minus the identity."""
    if not n or not usable:
        return 0.0

    def moments(mean: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(usable if mean is None else (usable, usable))
            for batch in batches:
                if batch.num_rows:
                    w, weight = _matrix(batch.column(0))[:, :usable].astype(float), batch.column(1).to_numpy()[:, None]
                    total += (w * weight).sum(axis=0) if mean is None else ((w - mean) * weight).T @ (w - mean)
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["cell", "value"])

        cells = white.select("whitened", "weight").mapInArrow(run, "cell int, value double").groupBy("cell").agg(
            F.sum("value").alias("value")).collect()
        return np.array([c["value"] for c in sorted(cells, key=lambda c: c["cell"])]) / n

    covariance = moments(moments(None)).reshape(usable, usable)
    return float(np.abs(covariance - np.eye(usable)).max())


def whitening(
    vectors: DataFrame, components: int = COMPONENTS, counted: bool = False, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each complete vector and
    component, ``components`` at most.

    Vectors become integers x = floor(64 c) + 1000000. Equal ones are one vector of the fit, which weighs one or, with
    ``counted``, its number of rows. S are the sums and V the covariance of the fit, centred before it is multiplied; all
    sums are of integers and exact, so that the same table gives the same result however it is dealt. deviation is the
    sum of (n x - S)^2 (null where it exceeds 64 bits), whitened the projection of x - S/n on a unit eigenvector of V over
    the root of its eigenvalue, explained the eigenvalue's share of the trace, identity_error how far the covariance of the
    whitened fit is from the identity.

    Each distinct vector is whitened once and joined back. It goes to each block of rows that holds it once, so a
    vector that fills the table is spread like any other.

    Rows with a null vector, or null or non-finite entries, are dropped. Vectors without entries have no components. Vectors
    must agree in length; the most frequent length counts (of several the largest), others are dropped. Null and repeated ids are kept
    as rows of their own; other columns are ignored. Where the vectors do not differ in a direction (one distinct
    vector, for example), whitened is null and explained about 0 (0 if nothing differs); such components are left
    out of identity_error. An empty table gives no rows.
    """
    rows = quantised(vectors, id_col, vector_col)
    rows = written(rows.withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit("x"), "x"), "row": F.monotonically_increasing_id()}),
                   "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    blocks = max(1, -(-(lengths["n"] if lengths else 0) // BLOCK_ROWS))
    rows = rows.where(F.size("x") == d).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    groups = rows.groupBy("k1", "k2", "x").agg(F.count(F.lit(1)).alias("copies"))
    distinct = written(groups.withColumn("weight", F.col("copies") if counted else F.lit(1).cast("long")), "distinct")
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k1", "k2").alias("keys")).first()
    if size["n"] != size["keys"]:
        raise ValueError("two different vectors have the same 128-bit key")

    found = fit(distinct)
    components = min(components, len(found.sums))
    white = written(_whitened(distinct, found, components), "whitened")
    usable = int((found.values[:components] > FLAT * max(found.trace, 1e-300)).sum())
    error = identity_error(white, found.n, usable)
    explained = [float(max(v, 0.0)) / found.trace if found.trace else 0.0 for v in found.values[:components]]

    held = rows.groupBy("k1", "k2", "block").agg(F.count(F.lit(1)).alias("_rows")).select("k1", "k2", "block")
    sent = held.join(white.drop("weight"), ["k1", "k2"])
    shares = F.lit(explained).cast("array<double>") if explained else F.array().cast("array<double>")
    return (
        rows.select("vec_id", "k1", "k2", "block").join(sent, ["k1", "k2", "block"])
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation",
                "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
    )
