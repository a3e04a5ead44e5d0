"""Vector and score arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null for empty vectors, other lengths and a norm of zero."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size)


def lenient_cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where there is none."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(x) * norm(y)
    return F.when((n > 0) & (size > 0), dot(x, y) / size).otherwise(0.0)


def shortened(v: Column, size: int = 768) -> Column:
    """The first components, at length one again."""
    part = F.slice(doubles(v), 1, size)
    length = F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(part, lambda x: x / length)).otherwise(part)


def hybrid(vector: Column, keyword: Column, share: float = 0.6) -> Column:
    return share * F.coalesce(vector, F.lit(0.0)) + (1 - share) * F.coalesce(keyword, F.lit(0.0))


def cluster_score(top: Column, members: Column) -> Column:
    return top * F.log2(members + 1)


def evidence(claim: Column, support: Column, contradict: Column) -> Column:
    """relation, confidence and score of three similarities; a difference under 0.03 is neutral."""
    s, c = F.coalesce(support, F.lit(0.0)), F.coalesce(contradict, F.lit(0.0))
    gap = F.abs(s - c)
    near = gap < 0.03
    relation = F.when(near, "neutral").when(s > c, "supports").otherwise("contradicts")
    confidence = F.when(near, 0.5).otherwise(F.least(F.lit(0.95), 0.5 + 4 * gap))
    return F.struct(relation.alias("relation"), confidence.alias("confidence"), F.greatest(F.coalesce(claim, F.lit(0.0)), s, c).alias("score"))


def zone(score: Column, auto: float, review: float) -> Column:
    return F.when(score >= auto, "auto").when(score >= review, "review").otherwise("reject")


def micro_units(amount: Column) -> Column:
    return F.round(amount * 1_000_000).cast("long")


def floor_of(asked: float | None, least: float = 0.62) -> float:
    """The association floor can only be raised."""
    return least if asked is None else max(least, min(asked, 1.0))


def _float32s(column: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(values as one float32 array, offsets in values, validity): lists with null entries count as null."""
    lists = column.cast(pa.list_(pa.float32()))
    flat = lists.flatten()
    size = np.array(lists.value_lengths().fill_null(0))
    known = np.array(lists.is_valid())
    if flat.null_count:
        holes = np.zeros(len(lists), np.int64)
        np.add.at(holes, np.repeat(np.arange(len(lists)), size), np.array(flat.is_null()))
        known &= holes == 0
    return flat.fill_null(0), np.concatenate([[0], np.cumsum(size)]), known


@F.arrow_udf(BinaryType())
def packed_vector(vectors: pa.Array) -> pa.Array:
    """Vectors as little-endian float32 bytes: the values' buffer as it is, with offsets four times as large. Null for null vectors and those with null entries."""
    flat, at, known = _float32s(vectors)
    data = pa.py_buffer(np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), "<f4"))
    held = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at * 4, np.int64)), data])
    return pc.if_else(pa.array(known), held.cast(pa.binary()), pa.scalar(None, pa.binary()))


@F.arrow_udf(ArrayType(FloatType()))
def _unpacked(held: pa.Array) -> pa.Array:
    size = np.array(pc.fill_null(pc.binary_length(held), 0))
    known = np.array(held.is_valid()) & (size % 4 == 0)
    body = b"".join(x for x, k in zip(held.to_pylist(), known, strict=True) if k)
    at = np.concatenate([[0], np.cumsum(np.where(known, size // 4, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(body, "<f4")))
    return pc.if_else(pa.array(known), lists, pa.scalar(None, lists.type))


def unpacked_vector(held: Column, dim: int) -> Column:
    """The vector of packed bytes; an error where they are not `dim` numbers, null where they are null."""
    wrong = F.raise_error(F.concat(F.lit("packed vector has "), F.length(held), F.lit(f" bytes, not {4 * dim}")))
    return F.when(held.isNotNull() & (F.length(held) != 4 * dim), wrong.cast("array<float>")).otherwise(_unpacked(held))


def vector_key(model: str, dim: int, text: Column) -> Column:
    """The key under which a text's vector is kept."""
    return F.concat(F.lit(f"emb:{model}:{dim}:"), F.sha2(text, 256))
