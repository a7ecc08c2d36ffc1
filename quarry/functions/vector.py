"""Cosine distance between embedding columns and query vectors.

Two forms of the same function:

* ``cosine_distance_arrow`` — an Arrow UDF doing one numpy matrix-vector product per
  batch; what searches use unless told otherwise.
* ``cosine_distance`` — a native Catalyst expression (``zip_with`` + ``aggregate``) in
  double precision, interpreted per element; it needs no Python worker.

Distance is ``1 - v.q / (|v| |q|)`` in ``[0, 2]``; a zero vector gives NaN,
which never passes a ``distance < t`` threshold and sorts last.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def vector_literal(q) -> Column:
    return F.array(*[F.lit(float(x)).cast("double") for x in q])


def dot(a, b) -> Column:
    prods = F.zip_with(_as_col(a), _as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_as_col(v), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _one_minus_ratio(num: Column, den: Column) -> Column:
    # IEEE semantics for a zero vector (NaN), also under ANSI mode where a plain
    # division by zero raises; try_divide evaluates each operand once
    return F.coalesce(F.lit(1.0) - F.try_divide(num, den), F.lit(float("nan")))


def cosine_distance(v, q) -> Column:
    """Native expression; ``q`` is a Python sequence (query literal) or a Column."""
    if isinstance(q, Column):
        return _one_minus_ratio(dot(v, q), norm(v) * norm(q))
    qn = math.sqrt(sum(float(x) * float(x) for x in q))
    return _one_minus_ratio(dot(v, vector_literal(q)), norm(v) * F.lit(qn))


def cosine_distance_arrow(v, q) -> Column:
    """Arrow form for a fixed query vector ``q``: one matrix product per batch, on the batch's own
    buffer. A null vector, or one of another length, has distance NaN."""
    qv = np.asarray(q, dtype=np.float64)
    qn, dims = float(np.linalg.norm(qv)), len(qv)

    def run(vectors: pa.Array) -> pa.Array:
        ok = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False)
        flat = (vectors if ok.all() else vectors.filter(pa.array(ok))).flatten()
        m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        out = np.full(len(ok), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[ok] = 1.0 - (m @ qv) / (np.linalg.norm(m, axis=1) * qn)
        return pa.array(out)

    return F.arrow_udf(run, "double").asNondeterministic()(_as_col(v))


def has_dims(v, dims: int) -> Column:
    """Vector-length check (vectors are ``array<float>``; length is not a type)."""
    return F.size(_as_col(v)) == F.lit(dims)
