"""Vector arithmetic on array columns with built-in functions. Sums run in double; null vectors give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(v: Column | str, p: float = 2.0) -> Column:
    v = _d(v)
    if p == 1:
        return _sum(F.transform(v, F.abs))
    if p == 2:
        return F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return F.pow(_sum(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1.0 / p))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0.0 if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y))))


def nearness(distance: Column) -> Column:
    return 1 / (1 + distance)


def normalized(v: Column | str, p: float = 2.0) -> Column:
    """Divided by the p-norm, which counts as 1e-12 at least."""
    size = F.greatest(norm(v, p), F.lit(1e-12))
    return F.transform(_d(v), lambda x: x / size)


def unit(v: Column | str) -> Column:
    """Length 1; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size == 0, _d(v)).otherwise(F.transform(_d(v), lambda x: x / F.nullif(size, F.lit(0.0))))


def sign_bits(v: Column | str) -> Column:
    """A string with 1 for each positive component and 0 for the others."""
    return F.array_join(F.transform(_d(v), lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")


def packed_bits(v: Column | str) -> Column:
    """Bit i of byte i / 8, the lowest first, is set iff component i is positive; as binary."""
    v = _d(v)
    size = F.size(v)
    octets = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / 8).cast("int")), lambda i: F.aggregate(F.slice(v, i * 8 + 1, F.lit(8)), F.struct(F.lit(0).alias("b"), F.lit(1).alias("w")), lambda acc, x: F.struct((acc["b"] + F.when(x > 0, acc["w"]).otherwise(0)).alias("b"), (acc["w"] * 2).alias("w")), lambda acc: F.lpad(F.hex(acc["b"]), 2, "0")))
    return F.when(size == 0, F.unhex(F.lit(""))).when(v.isNotNull(), F.unhex(F.array_join(octets, "")))


def unpacked_signs(bits: Column | str, dims: int) -> Column:
    """1.0 for each set bit, -1.0 for the others and beyond the end."""
    h = F.hex(F.col(bits) if isinstance(bits, str) else bits)
    octet = lambda i: F.conv(F.substring(h, (F.floor(i / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(F.coalesce((octet(i) / F.pow(F.lit(2), i % 8)).cast("long") % 2 == 1, F.lit(False)), F.lit(1.0)).otherwise(F.lit(-1.0)))


def agreement(a: Column | str, b: Column | str) -> Column:
    """Share of components whose signs agree (1 - Hamming distance / dimensions); null for empty vectors."""
    a, b = _d(a), _d(b)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) != (y > 0)).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return 1 - differ / F.nullif(F.size(a), F.lit(0))
