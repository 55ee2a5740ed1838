"""Images: decoding by Spark's source, quality and signatures by a vectorised kernel over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "origin string, status string, height int, width int, laplacian_variance double, gradient_energy double, mean double, contrast double, entropy double, dhash long, phash long"


def cosine_basis(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def resample(luma: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Block means at a fixed size."""
    y = np.minimum((np.arange(rows + 1) * luma.shape[0]) // rows, luma.shape[0] - 1)
    x = np.minimum((np.arange(cols + 1) * luma.shape[1]) // cols, luma.shape[1] - 1)
    return luma[np.ix_(y[:-1], x[:-1])] if min(luma.shape) < max(rows, cols) else np.add.reduceat(np.add.reduceat(luma, y[:-1], axis=0), x[:-1], axis=1) / np.maximum(np.diff(y)[:, None] * np.diff(x)[None, :], 1)


def bits(flags: np.ndarray) -> int:
    value = int("".join("1" if f else "0" for f in flags.ravel()[:64]), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def measure(luma: np.ndarray) -> tuple:
    gx, gy = np.diff(luma, axis=1), np.diff(luma, axis=0)
    lap = luma[1:-1, 2:] + luma[1:-1, :-2] + luma[2:, 1:-1] + luma[:-2, 1:-1] - 4 * luma[1:-1, 1:-1]
    share = np.bincount((luma * 255).astype(int).ravel(), minlength=256) / luma.size
    share = share[share > 0]
    low = cosine_basis(32, 8) @ resample(luma, 32, 32) @ cosine_basis(32, 8).T
    small = resample(luma, 8, 9)
    return (
        float(lap.var()) if lap.size else 0.0, float((gx**2).mean() + (gy**2).mean()) if gx.size and gy.size else 0.0, float(luma.mean()), float(luma.std()),
        float(-(share * np.log2(share)).sum()) + 0.0, bits(small[:, 1:] > small[:, :-1]), bits(low.ravel() > np.median(low.ravel()[1:])),
    )


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: size, sharpness, gradient, exposure, entropy and two 64-bit signatures; broken files get status ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.height <= 0:
                    out.append((r.origin, "error", None, None, *[None] * 7))
                    continue
                px = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.float64) / 255
                luma = px[:, :, 0] if r.nChannels == 1 else px[:, :, :3] @ np.array([0.114, 0.587, 0.299])  # stored as BGR
                out.append((r.origin, "ready", r.height, r.width, *measure(luma)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, SCHEMA)


def score_model(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], *, key: str, engine: str, version: str) -> DataFrame:
    """Plug-in model over Arrow batches, loaded once per task: key, score, engine, version, status, error.

    A batch whose model fails gives rows with status ``error``.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out = pd.DataFrame({key: batch[key], "score": None, "engine": engine, "version": version, "status": "ready", "error": None})
            try:
                out["score"] = model(batch).astype(float)
            except Exception as e:  # the model is the user's; its failure is data
                out["status"], out["error"] = "error", f"{type(e).__name__}: {e}"[:200]
            yield out

    return df.mapInPandas(run, f"{key} {kind}, score double, engine string, version string, status string, error string")
