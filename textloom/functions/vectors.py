"""Vector functions as columns over array<double>; float arrays are widened before arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _vector(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(values: list[float]) -> Column:
    """A query vector inside the plan: nearest neighbours need no join."""
    return F.array(*[F.lit(float(x)) for x in values])


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_vector(a), _vector(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_vector(v), lambda x: x * x)))


def normalise(v: Column | str) -> Column:
    """v over its length; a zero vector as it is."""
    v, n = _vector(v), norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for empty or zero vectors and unlike lengths."""
    a, b = _vector(a), _vector(b)
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Infinite for unlike lengths."""
    a, b = _vector(a), _vector(b)
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))).otherwise(F.lit(float("inf")))


def similarity(distance: Column, kind: str) -> Column:
    """Of a distance: half (1 - d/2), one (1 - d) or inverse (1 / (1 + d))."""
    return {"half": 1 - distance / 2, "one": 1 - distance, "inverse": 1 / (1 + distance)}[kind]


def is_valid(v: Column | str) -> Column:
    v = _vector(v)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def padded(v: Column | str, dim: int) -> Column:
    """v cut or filled with zeros to dim."""
    return F.slice(F.concat(_vector(v), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def _hex_values(digest: Column, digits: int, count: int) -> Column:
    at = F.sequence(F.lit(0), F.lit(count - 1))
    return F.transform(at, lambda i: F.conv(F.substr(digest, i * digits + 1, F.lit(digits)), 16, 10).cast("double"))


def md5_vector(text: Column | str, dim: int = 384) -> Column:
    """16 digest bytes over 255, zeros up to dim, normalised."""
    t = F.col(text) if isinstance(text, str) else text
    return normalise(padded(F.transform(_hex_values(F.md5(t), 2, 16), lambda x: x / 255), dim))


def md5_nibble_vector(text: Column | str, dim: int = 512) -> Column:
    """32 digest nibbles of the first 1024 characters over 16, zeros up to dim."""
    t = F.col(text) if isinstance(text, str) else text
    return padded(F.transform(_hex_values(F.md5(F.substring(t, 1, 1024)), 1, 32), lambda x: x / 16), dim)


def sha_vector(text: Column | str, dim: int = 768) -> Column:
    """32 digest bytes as (b - 128) / 128, zeros up to dim."""
    t = F.col(text) if isinstance(text, str) else text
    return padded(F.transform(_hex_values(F.sha2(t, 256), 2, 32), lambda x: (x - 128) / 128), dim)
