"""Embedding tables with raw f32/f16 vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decode(blobs: pd.Series, dims: pd.Series, dtypes: pd.Series) -> pd.Series:
    kinds = {"f32": np.dtype("<f4"), "f16": np.dtype("<f2")}

    def one(blob, dim, dtype):
        kind = kinds.get(dtype)
        if blob is None or kind is None or len(blob) != dim * kind.itemsize:
            return None
        return np.frombuffer(blob, dtype=kind).astype(np.float32)

    return pd.Series([one(b, d, t) for b, d, t in zip(blobs, dims, dtypes)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def encode_vectors(df: DataFrame, col: str) -> DataFrame:
    """Array column to (dim, dtype, vec_blob) as stored."""
    return df.withColumn("dim", F.size(col).cast("short")).withColumn("dtype", F.lit("f32")).withColumn("vec_blob", _encode(col)).drop(col)


def scan_embeddings(table: DataFrame) -> DataFrame:
    """Decode ``vec_blob``; a blob whose length is not dim x width gives null."""
    return table.withColumn("vector", _decode("vec_blob", F.col("dim").cast("int"), "dtype"))


def embeddings_info(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored vectors beside their nodes, without the vectors."""
    t = table.select("node_id", "dim", "dtype", F.octet_length("vec_blob").alias("bytes"))
    return t.join(nodes.select(F.col("id").alias("node_id"), "title"), "node_id").select("node_id", "title", "dim", "dtype", "bytes")
