"""Principal components of the cell × gene matrix without a gene × gene matrix.

The leading eigenvectors of the covariance are found by block Lanczos steps: one pass over the cells multiplies the covariance
with a thin block of columns, centring as it goes, so the largest arrays are genes × a few hundred. New directions are the
residuals of the present Ritz vectors, made orthogonal to the whole basis; a full basis is cut back to the Ritz vectors, whose
images are known and cost no pass. A matrix with no more genes than one block has columns is solved by a single pass.

Rows hold ``values``, one per gene, or ``indices`` and ``values`` of the entries that are not zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from guidescape.runtime import importable

BLOCK = 64  # columns of the first block at least
BASIS = 256  # columns of the basis at which it is cut back
TOLERANCE = 1e-9  # of a residual against the largest eigenvalue
PASSES = 200
ROWS = 1 << 22  # numbers in a stretch of cells that is multiplied at once
SLICE = 1 << 16  # numbers in a row of partial sums


@dataclass
class Components:
    """``vectors``: genes × k, ``variances`` along them, ``everything``: the variance of all genes together."""

    mean: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    everything: float


def _stretches(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Cells of a task as dense rows, a bounded number at a time."""
    step = max(1, ROWS // max(width, 1))
    for pdf in batches:
        for at in range(0, len(pdf), step):
            part = pdf.iloc[at : at + step]
            if "indices" in part:
                x = np.zeros((len(part), width))
                row = np.repeat(np.arange(len(part)), [len(i) for i in part["indices"]])
                if len(row):
                    np.add.at(x, (row, np.concatenate(part["indices"].to_list())), np.concatenate(part["values"].to_list()))
            else:
                x = np.stack([np.asarray(v, float) for v in part["values"]])
            yield part, x


def _inputs(rows: DataFrame) -> list[str]:
    return ["indices", "values"] if "indices" in rows.columns else ["values"]


def summed(rows: DataFrame, width: int, height: int, columns: int, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sum over all cells of what ``add`` puts into a height × columns array, one array per task, added up by slices."""
    inputs = _inputs(rows)
    slice_rows = max(1, SLICE // columns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((height, columns))
        for _, x in _stretches(batches, width):
            add(out, x)
        for at in range(0, height, slice_rows):
            yield pd.DataFrame({"at": [at], "sums": [out[at : at + slice_rows].tobytes()]})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(len(pdf["sums"].iloc[0]) // 8)
        for part in pdf["sums"]:
            sums += np.frombuffer(part)
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "sums": [sums.tobytes()]})

    importable(rows.sparkSession)
    parts = rows.select(*inputs).mapInPandas(partial, "at int, sums binary")
    out = np.zeros((height, columns))
    for row in parts.groupBy("at").applyInPandas(together, "at int, sums binary").collect():
        sums = np.frombuffer(row["sums"]).reshape(-1, columns)
        out[row["at"] : row["at"] + len(sums)] = sums
    return out


def _orthogonal(block: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Orthonormal columns for what of ``block`` lies outside ``basis``; directions that vanish are left out."""
    lengths = np.linalg.norm(block, axis=0)
    block = block[:, lengths > 0] / lengths[lengths > 0]
    for _ in range(2):
        if basis is not None:
            block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
    return block


def leading_eigenvectors(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 55) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, and their vectors, of a symmetric operator known by its products with thin blocks."""
    k = min(k, d)
    start = np.random.default_rng(seed).normal(size=(d, min(d, max(BLOCK, k + 8))))
    basis = _orthogonal(start, None)
    image = multiply(basis)
    for _ in range(PASSES):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        vectors = basis @ turn[:, :k]
        rest = image @ turn[:, :k] - vectors * values[:k]
        open_ = np.linalg.norm(rest, axis=0) > TOLERANCE * max(abs(values[0]), 1e-300)
        if not open_.any() or basis.shape[1] == d:
            break
        if basis.shape[1] + open_.sum() > max(BASIS, 2 * k + BLOCK):
            keep = k + BLOCK // 2
            basis, image = basis @ turn[:, :keep], image @ turn[:, :keep]
        new = _orthogonal(rest[:, open_], basis)
        if not new.shape[1]:
            break
        basis, image = np.hstack([basis, new]), np.hstack([image, multiply(new)])
    return values[:k], vectors


def leading_singular_values(rows: DataFrame, k: int, width: int) -> np.ndarray:
    """The ``k`` largest singular values of the matrix as it stands, not centred."""

    def multiply(block: np.ndarray) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def add(out: np.ndarray, x: np.ndarray) -> None:
            out += x.T @ (x @ sent.value)

        product = summed(rows, width, width, block.shape[1], add)
        sent.unpersist()
        return product

    return np.sqrt(np.maximum(leading_eigenvectors(multiply, width, k)[0], 0.0))


def principal_components(rows: DataFrame, k: int, width: int | None = None) -> Components:
    """The first ``k`` components. ``width``: number of genes, needed for rows with ``indices``, else read from the rows.

    The sign of a component is chosen so that its largest entry is positive.
    """
    if width is None:
        width = rows.agg(F.max(F.size("values"))).first()[0] or 0
    n = rows.count()
    if not n or not width:
        return Components(np.zeros(width), np.zeros((width, 0)), np.zeros(0), 0.0)

    def total(out: np.ndarray, x: np.ndarray) -> None:
        out[:, 0] += x.sum(axis=0)

    mean = summed(rows, width, width, 1, total)[:, 0] / n

    def squares(out: np.ndarray, x: np.ndarray) -> None:
        out += ((x - mean) ** 2).sum()

    scale = max(n - 1, 1)
    everything = float(summed(rows, width, 1, 1, squares)[0, 0]) / scale

    def multiply(block: np.ndarray) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast((block, mean @ block))  # genes × a thin block

        def add(out: np.ndarray, x: np.ndarray) -> None:
            v, shift = sent.value
            p = x @ v - shift
            out[:-1] += x.T @ p
            out[-1] += p.sum(axis=0)

        sums = summed(rows, width, width + 1, block.shape[1], add)
        sent.unpersist()
        return (sums[:-1] - np.outer(mean, sums[-1])) / scale

    values, vectors = leading_eigenvectors(multiply, width, k)
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Components(mean, vectors, np.maximum(values, 0.0), everything)


def project(rows: DataFrame, components: Components) -> DataFrame:
    """cell_id and ``values``, the cell's places along the components."""
    kind, inputs, width = dict(rows.dtypes)["cell_id"], _inputs(rows), len(components.mean)
    sent = importable(rows.sparkSession).sparkContext.broadcast(components)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, shift = sent.value.vectors, sent.value.mean @ sent.value.vectors
        for part, x in _stretches(batches, width):
            yield pd.DataFrame({"cell_id": part["cell_id"], "values": list(x @ vectors - shift)})

    return rows.select("cell_id", *inputs).mapInPandas(place, f"cell_id {kind}, values array<double>")


def pc_variance(wide: DataFrame, k: int, width: int | None = None) -> DataFrame:
    """Share of variance explained by each of the first ``k`` components."""
    found = principal_components(wide, k, width)
    shares = [(i + 1, float(v / (found.everything or 1.0))) for i, v in enumerate(found.variances)]
    return wide.sparkSession.createDataFrame(shares, "component int, explained double")


def pca_embedding(wide: DataFrame, k: int, width: int | None = None) -> DataFrame:
    """Cells projected on the first ``k`` components."""
    return project(wide, principal_components(wide, k, width))


def coordinates(embedding: DataFrame) -> DataFrame:
    """First two positions of an embedding as ``dim1``, ``dim2``."""
    return embedding.select(
        "cell_id", F.col("values")[0].cast("double").alias("dim1"), F.col("values")[1].cast("double").alias("dim2")
    )
