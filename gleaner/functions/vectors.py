"""Vectors as base64 text of little-endian 32-bit floats, over Arrow batches."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf


@pandas_udf("string")
def encode_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, dtype="<f4").tobytes()).decode())


@pandas_udf("array<float>")
def decode_vector(texts: pd.Series) -> pd.Series:
    """The vector; null for broken text, an empty vector or non-finite components."""

    def one(text: str | None) -> list[float] | None:
        try:
            raw = base64.b64decode(text, validate=True)
            v = np.frombuffer(raw, dtype="<f4")
        except (ValueError, TypeError):
            return None
        return v.tolist() if len(v) and np.isfinite(v).all() else None

    return texts.map(one)
