"""Vector expressions over array columns, in double precision and inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def total(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v) -> Column:
    """v over its length, which counts as 1e-12 at least."""
    length = F.greatest(norm(v), F.lit(TINY))
    return F.transform(col(v), lambda x: x.cast("double") / length)


def distance(a, b) -> Column:
    return F.sqrt(total(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def argmax(v) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(col(v), F.array_max(col(v))) - 1).cast("int")


def clip_above(v, limits) -> Column:
    return F.zip_with(col(v), col(limits), lambda x, y: F.least(x.cast("double"), y.cast("double")))


def softmax(v) -> Column:
    most = F.array_max(col(v))
    powers = F.transform(col(v), lambda x: F.exp(x - most))
    return F.transform(powers, lambda x: x / total(powers))


def energy(v, temperature: float = 1.0) -> Column:
    scaled = F.transform(col(v), lambda x: x / F.lit(float(temperature)))
    most = F.array_max(scaled)
    return F.lit(float(temperature)) * (most + F.log(total(F.transform(scaled, lambda x: F.exp(x - most)))))


def negative_entropy(v) -> Column:
    return total(F.transform(softmax(v), lambda p: p * F.log(p + F.lit(TINY))))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def f1(precision, recall) -> Column:
    """Their harmonic mean, with a guarded denominator."""
    p, r = col(precision), col(recall)
    return 2 * p * r / F.greatest(p + r, F.lit(TINY))
