"""Column functions over numeric arrays and hashes; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """``v`` scaled to length one; the zero vector stays."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def bounded_softmax(z: Column, bound: float = 5.0, temperature: float = 1.0) -> Column:
    """Softmax of logits squashed to (-bound, bound)."""
    e = F.transform(z, lambda x: F.exp(F.tanh(x / bound) * bound / temperature))
    return F.transform(e, lambda x: x / total(e))


def renormalise(p: Column, mask: Column) -> Column:
    """Weights over what is available, summing to one where anything is."""
    kept = F.zip_with(p, mask, lambda x, m: x * m)
    return F.transform(kept, lambda x: x / F.greatest(total(kept), F.lit(1e-9)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit(p: Column) -> Column:
    q = clipped(p, 1e-7, 1 - 1e-7)
    return F.log(q / (1 - q))


def at_temperature(p: Column, t: float) -> Column:
    """A probability at temperature ``t``."""
    return sigmoid(clipped(logit(p) / t, -50.0, 50.0))


def seeded(seed: object, *keys: Column) -> Column:
    """A hex digest that orders rows at random, the same for any partitioning."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256)


def uniform(seed: object, *keys: Column) -> Column:
    """A number in [0, 1) from the first twelve hex digits of the seeded digest."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 12), 16, 10).cast("double") / float(16**12)
