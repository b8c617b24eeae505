"""Vector expressions over ``array`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of the deterministic stand-in for a text encoder.
HASH_DIMS = 16


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either vector is null or their lengths differ."""
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector gives NaN components."""
    length = norm(v)
    return F.transform(F.arrays_zip(as_doubles(v).alias("x")), lambda e: F.coalesce(F.try_divide(e["x"], length), F.lit(float("nan"))))


def l2_normalize_safe(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = F.when(norm(v) == 0, F.lit(1e-9)).otherwise(norm(v))
    return F.transform(as_doubles(v), lambda x: x / length)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Unit vector of the mean of the ``vectors`` (an array of arrays) whose ``mask`` is not 0.

    The count is taken as 1e-9 at least, so with nothing marked the result is
    the zero vector; no vectors at all give null.
    """
    marked = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda e: e["m"] != 0)
    weight = F.greatest(F.size(marked).cast("double"), F.lit(1e-9))
    zeros = F.transform(as_doubles(vectors[0]), lambda _: F.lit(0.0))
    total = F.aggregate(marked, zeros, lambda s, e: F.zip_with(s, as_doubles(e["v"]), lambda a, b: a + b))
    return F.when(F.size(vectors) > 0, l2_normalize_safe(F.transform(total, lambda x: x / weight)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable(v: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` finite numbers that are not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def hash_embed(text: Column, dims: int = HASH_DIMS) -> Column:
    """A deterministic stand-in for an encoder: signed bits of the text's SHA-256, as a unit vector."""
    digest = F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, dims // 4), 16, 2)
    bits = F.split(F.lpad(digest, dims, "0"), "")
    signs = F.transform(F.filter(bits, lambda b: b != ""), lambda b: F.when(b == "1", 1.0).otherwise(-1.0))
    return F.transform(signs, lambda x: x / float(dims) ** 0.5)
