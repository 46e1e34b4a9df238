"""Dense vectors: batched inference, zero fill, length normalisation, truncated SVD."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vernissage.functions.numeric import length_of, once, scaled


def batch_inference(make_predict: Callable, size: int, batch_size: int = 64):
    """Column function of a caller's model: one array in, one vector out, in Arrow batches."""
    return predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[[size]],
    )


def with_zero_vectors(ids: DataFrame, vectors: DataFrame, size: int, key: str = "id", vec: str = "vec") -> DataFrame:
    """Every id; one without a vector gets zeros."""
    zeros = F.array_repeat(F.lit(0.0), size)
    return ids.join(vectors, key, "left").withColumn(vec, F.coalesce(vec, zeros))


def l2_normalised(vec: str | Column = "vec") -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    v = F.col(vec) if isinstance(vec, str) else vec

    def divisor(a: Column) -> Column:
        return once(length_of(a), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))

    return scaled(v, divisor)


NARROW = 4
HELD_BLOCKS = 6


@dataclass(frozen=True)
class TruncatedSvd:
    """Right singular vectors of a row matrix without centring.

    Each pass multiplies the Gram matrix of the rows with a thin block inside the
    tasks; only n_features x (k + oversample) numbers come back from it, whatever the
    number of rows. The driver keeps at most HELD_BLOCKS such blocks, finds the best
    directions in their span and sends what these miss as the next block. `residual` is
    the longest such miss of the k directions, as a share of the largest eigenvalue:
    each squared singular value is that close to one of the rows' own. Passes end when
    it is at most `tolerance`, or after `most_passes`.
    """

    components: np.ndarray  # n_features x k
    singular_values: np.ndarray
    explained_ratio: float
    residual: float
    passes: int

    @classmethod
    def fit(
        cls, rows: DataFrame, n_features: int, k: int, seed: int = 42, tolerance: float = 0.001, most_passes: int = 12, oversample: int = 10,
    ) -> TruncatedSvd:
        """`rows` holds either `vec` (dense array) or `idx` and `val` (sparse arrays).

        They are read once per pass and not kept in memory, so land rows that are costly to make.
        """
        k = min(k, n_features)
        width = min(k + oversample, n_features)
        columns = ["vec"] if "vec" in rows.columns else ["idx", "val"]
        data = rows.select(*columns)
        if n_features <= NARROW * width:  # the whole Gram matrix in one pass
            block = np.eye(n_features)
        else:
            block = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_features, width)))[0]
        basis = image = np.zeros((n_features, 0))
        passes = 0
        while True:
            product, sums, squares, n = _gram_times(data, block)
            passes += 1
            basis, image = np.hstack([basis, block]), np.hstack([image, product])
            values, inner = np.linalg.eigh(_symmetric(basis.T @ image))
            values, inner = values[::-1], inner[:, ::-1]
            missed = image @ inner[:, :width] - basis @ inner[:, :width] * values[:width]
            residual = _share(np.linalg.norm(missed[:, :k], axis=0).max(), values[0])
            block = _beside(basis, missed, values[0])
            if residual <= tolerance or passes >= most_passes or not block.shape[1]:
                break
            if basis.shape[1] + block.shape[1] > HELD_BLOCKS * width:
                basis, image = basis @ inner[:, : 2 * width], image @ inner[:, : 2 * width]
        values, components = values[:k], basis @ inner[:, :k]
        peak = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
        components = components * np.where(peak < 0, -1.0, 1.0)
        energy = np.maximum(values, 0.0)
        score_variance = energy / n - (sums / n @ components) ** 2
        input_variance = squares / n - (sums / n) ** 2
        return cls(components, np.sqrt(energy), _share(score_variance.sum(), input_variance.sum()), residual, passes)

    def scores(self, rows: DataFrame, key: str = "id", prefix: str = "svd_") -> DataFrame:
        """Row scores X V as columns <prefix>0, <prefix>1, ..."""
        components = self.components
        names = ["vec"] if "vec" in rows.columns else ["idx", "val"]
        kind = rows.schema[key].dataType.simpleString()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                found = _dense(part.select(names), components.shape[0]) @ components
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))], names=[key, "_s"])

        scored = rows.select(key, *names).mapInArrow(score, f"`{key}` {kind}, _s array<double>")
        return scored.select(key, *[F.col("_s")[i].alias(f"{prefix}{i}") for i in range(components.shape[1])])


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _share(part: float, whole: float) -> float:
    return float(part / whole) if whole > 0 else 0.0


def _beside(basis: np.ndarray, block: np.ndarray, scale: float) -> np.ndarray:
    """Orthonormal directions of `block` outside the basis; none where it adds no more than rounding."""
    lengths = np.linalg.norm(block, axis=0)
    block = block[:, lengths > 1e-12 * scale] / lengths[lengths > 1e-12 * scale]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        left, strength, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, strength > 1e-8]
    return block


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def _dense(part: pa.RecordBatch, n_features: int) -> np.ndarray:
    """Rows as one block; a null vector is a row of zeros, as where inference has failed."""
    out = np.zeros((part.num_rows, n_features))
    size = np.array(part.column(0).value_lengths().fill_null(0))
    entries = [column.flatten().to_numpy(zero_copy_only=False) for column in part.columns]
    if len(entries) == 1:
        if not np.isin(size[np.array(part.column(0).is_valid())], n_features).all():
            raise ValueError(f"vectors must have {n_features} numbers")
        out[size > 0] = entries[0].reshape(-1, n_features)
    else:
        out[np.repeat(np.arange(len(size)), size), entries[0]] = entries[1]
    return out


BLOCK_ROWS = 512
WIDE_TASKS = 4


def _gram_times(rows: DataFrame, basis: np.ndarray):
    """(X'X) basis, column sums, column square sums and row count, added up over all tasks."""
    n_features, width = basis.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((n_features, width))
        sums, squares, n = np.zeros(n_features), np.zeros(n_features), 0
        for part in _parts(batches):
            block = _dense(part, n_features)
            product += block.T @ (block @ basis)
            sums += block.sum(axis=0)
            squares += np.einsum("ij,ij->j", block, block)
            n += len(block)
        if n:
            columns = [np.arange(n_features, dtype=np.int32), np.full(n_features, n), sums, squares]
            ends = pa.array(np.arange(n_features + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(ends, pa.array(product.reshape(-1)))], names=[*"jnsqz"])

    wide = WIDE_TASKS * rows.sparkSession.sparkContext.defaultParallelism  # each task sends one partial product
    parts = rows.coalesce(wide).mapInArrow(partial, "j int, n long, s double, q double, z array<double>")
    added = parts.groupBy("j").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        *[F.sum(F.col("z")[i]).alias(f"z{i}") for i in range(width)],
    )
    got = added.orderBy("j").toPandas()
    product = got[[f"z{i}" for i in range(width)]].to_numpy()
    return product, got["s"].to_numpy(), got["q"].to_numpy(), int(got["n"].iloc[0])
