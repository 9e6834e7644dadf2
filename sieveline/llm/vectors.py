"""Embeddings as integer vectors, for the operators on embeddings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: an entry c becomes floor(SCALE * c)
SCALE = 256


def quantized(rows: DataFrame, vector: str, name: str = "x") -> DataFrame:
    """``rows`` with ``name``, the vector's entries as longs: floor(256 * entry).

    Rows go whose vector is null or empty, holds null or non-finite entries, or has another length than most vectors have (of
    equally frequent lengths the greater counts). Entries beyond the range of a long are held at its ends.
    """
    finite = ~F.exists(vector, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    good = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(finite)
    usual = good.groupBy(F.size(vector).alias("d")).count().agg(F.max(F.struct("count", "d"))["d"]).first()[0]
    whole = F.transform(vector, lambda e: F.floor(e.cast("double") * SCALE))
    return good.filter(F.size(vector) == (usual or 0)).withColumn(name, whole)


def matrix(batch: pa.RecordBatch, name: str = "x"):
    """A column of equally long lists as a matrix with a row a list."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)


def exact(x, bound: int):
    """Integers in which results up to ``bound`` are exact: longs, or Python's own where these are too small."""
    return x.astype(np.int64) if bound < 1 << 62 else x.astype(object)
