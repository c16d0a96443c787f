"""Distances, element-wise functions and norms as Columns over arrays.

Vectors are arrays of floats; sums run in double precision, element by element
from the first. Vectors of unequal length raise (``checked``), they never
compare silently. Null vectors give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLT_MIN = 1.17549435e-38
ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c: ColumnLike) -> Column:
    return col(c).cast("array<double>")


def checked(a: ColumnLike, b: ColumnLike) -> tuple[Column, Column]:
    """Both as doubles; rows of unequal length raise."""
    a, b = doubles(a), doubles(b)
    message = F.concat(F.lit("vectors of unequal length: "), F.size(a).cast("string"), F.lit(", "), F.size(b).cast("string"))
    return a, F.when(F.size(a) != F.size(b), F.raise_error(message).cast("array<double>")).otherwise(b)


def vsum(c: Column, f: Callable[[Column], Column] | None = None) -> Column:
    """Sum of f of the elements."""
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + (f(x) if f else x))


def vzip(a: ColumnLike, b: ColumnLike, f: Callable[[Column, Column], Column]) -> Column:
    a, b = checked(a, b)
    return F.zip_with(a, b, f)


def norm(c: ColumnLike) -> Column:
    return F.sqrt(vsum(doubles(c), lambda x: x * x))


# -- distances ---------------------------------------------------------------


def l2_squared(a: ColumnLike, b: ColumnLike) -> Column:
    return vsum(vzip(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: ColumnLike, b: ColumnLike) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a: ColumnLike, b: ColumnLike, absolute: bool = False) -> Column:
    d = vsum(vzip(a, b, lambda x, y: x * y))
    return F.abs(d) if absolute else d


def cosine_similarity(a: ColumnLike, b: ColumnLike, normalized: bool = False) -> Column:
    """In [-1, 1]; 0 where either vector has no length. normalized: both are unit vectors already."""
    d = dot(a, b)
    if not normalized:
        size = norm(a) * norm(b)
        d = F.when(size > FLT_MIN, d / size).otherwise(F.lit(0.0))
    return F.when(d.isNotNull(), F.least(F.greatest(d, F.lit(-1.0)), F.lit(1.0)))


def cosine_distance(a: ColumnLike, b: ColumnLike, normalized: bool = False) -> Column:
    return 1 - cosine_similarity(a, b, normalized)


def manhattan(a: ColumnLike, b: ColumnLike, weights: ColumnLike | None = None) -> Column:
    d = vzip(a, b, lambda x, y: F.abs(x - y))
    return vsum(d if weights is None else vzip(d, weights, lambda x, w: x * w))


def manhattan_mean(a: ColumnLike, b: ColumnLike) -> Column:
    return F.when(F.size(col(a)) > 0, manhattan(a, b) / F.size(col(a))).otherwise(F.lit(0.0))


def chebyshev(a: ColumnLike, b: ColumnLike, weights: ColumnLike | None = None, ranges: ColumnLike | None = None, cap: float | None = None) -> Column:
    """Greatest difference; weighted, or as a share of the ranges (empty ranges count 0), or cut off at cap."""
    d = vzip(a, b, lambda x, y: F.abs(x - y))
    if weights is not None:
        d = vzip(d, weights, lambda x, w: x * w)
    if ranges is not None:
        d = vzip(d, ranges, lambda x, r: F.when(r > 0, x / r).otherwise(F.lit(0.0)))
    out = F.coalesce(F.array_max(d), F.when(d.isNotNull(), F.lit(0.0)))
    return F.least(out, F.lit(float(cap))) if cap is not None else out


def minkowski(a: ColumnLike, b: ColumnLike, p: float) -> Column:
    """p > 0, also under 1. p near 1 and 2 take the direct sums, over 30 the greatest difference; else scaled by it."""
    if p <= 0:
        raise ValueError("p must be positive")
    if abs(p - 1) < 1e-3:
        return manhattan(a, b)
    if abs(p - 2) < 1e-3:
        return l2(a, b)
    most = chebyshev(a, b)
    if p > 30:
        return most
    d = vzip(a, b, lambda x, y: F.when(F.abs(x - y) < 1e-10, F.lit(0.0)).otherwise(F.abs(x - y)))
    return F.when(most > 0, most * F.pow(vsum(d, lambda x: F.pow(x / most, F.lit(float(p)))), F.lit(1.0 / p))).otherwise(F.when(most.isNotNull(), F.lit(0.0)))


def hamming(a: ColumnLike, b: ColumnLike, threshold: float = 0.0, normalized: bool = False) -> Column:
    """Places where one element is over the threshold and the other is not."""
    d = vsum(vzip(a, b, lambda x, y: F.when((x > threshold) != (y > threshold), F.lit(1.0)).otherwise(F.lit(0.0))))
    if not normalized:
        return d.cast("long")
    return F.when(F.size(col(a)) > 0, d / F.size(col(a))).otherwise(F.lit(0.0))


def hamming_words(a: ColumnLike, b: ColumnLike) -> Column:
    """Bits that differ between packed vectors (arrays of integers)."""
    return F.aggregate(F.zip_with(col(a).cast("array<bigint>"), col(b).cast("array<bigint>"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda acc, x: acc + x)


def ruzicka(a: ColumnLike, b: ColumnLike, eps: float = 1e-8) -> Column:
    """1 - sum of minima / sum of maxima; vectors without elements 0, without weight 1."""
    x, y = checked(a, b)
    low, high = vsum(F.zip_with(x, y, lambda p, q: F.least(p, q))), vsum(F.zip_with(x, y, lambda p, q: F.greatest(p, q)))
    return F.when(F.size(x) == 0, F.lit(0.0)).when(high <= eps, F.lit(1.0)).otherwise(1 - low / high)


def binary_jaccard(a: ColumnLike, b: ColumnLike, threshold: float = 0.0) -> Column:
    """1 - |A and B| / |A or B| of the places over the threshold; without elements 0, both without a place 1."""
    both = vsum(vzip(a, b, lambda x, y: F.when((x > threshold) & (y > threshold), F.lit(1.0)).otherwise(F.lit(0.0))))
    some = vsum(vzip(a, b, lambda x, y: F.when((x > threshold) | (y > threshold), F.lit(1.0)).otherwise(F.lit(0.0))))
    return F.when(F.size(col(a)) == 0, F.lit(0.0)).when(some == 0, F.lit(1.0)).otherwise(1 - both / some)


def mutual_reachability(a: ColumnLike, b: ColumnLike, core_a: ColumnLike, core_b: ColumnLike) -> Column:
    return F.greatest(col(core_a), col(core_b), l2(a, b))


#: Metrics by name; smaller is nearer, so dot is negated.
METRICS: dict[str, Callable[[ColumnLike, ColumnLike], Column]] = {
    "euclidean": l2_squared,
    "cosine": cosine_distance,
    "dot": lambda a, b: -dot(a, b),
    "manhattan": manhattan,
    "chebyshev": chebyshev,
    "hamming": hamming,
    "jaccard": ruzicka,
}


def register_metric(name: str, make: Callable[[ColumnLike, ColumnLike], Column]) -> None:
    """Add a metric: a function of two vector columns, smaller is nearer."""
    METRICS[name] = make


def distance(a: ColumnLike, b: ColumnLike, metric: str = "euclidean", p: float | None = None) -> Column:
    if metric == "minkowski":
        return minkowski(a, b, p or 2.0)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; known: {', '.join(sorted(METRICS))}, minkowski")
    return METRICS[metric](a, b)


# -- element by element ------------------------------------------------------

_INF, _NAN = float("inf"), float("nan")


def _max(x: Column, y: Column) -> Column:
    """The greater; NaN yields to the other."""
    return F.greatest(F.nanvl(x, y), F.nanvl(y, x))


def _min(x: Column, y: Column) -> Column:
    return F.least(F.nanvl(x, y), F.nanvl(y, x))


def safe_divide(x: Column, y: Column) -> Column:
    """As IEEE 754: x/0 is an infinity or NaN, never an error."""
    return F.when(y != 0, x / F.when(y != 0, y)).when((x == 0) | F.isnan(x), F.lit(_NAN)).when(x > 0, F.lit(_INF)).otherwise(F.lit(-_INF))


def safe_ln(x: Column) -> Column:
    """As IEEE 754: ln 0 is -inf, ln of a negative NaN."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-_INF)).when(x.isNotNull(), F.lit(_NAN))


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y,
    "divide": safe_divide, "power": F.pow, "maximum": _max, "minimum": _min,
}
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "square": lambda x: x * x, "sqrt": F.sqrt, "reciprocal": lambda x: safe_divide(F.lit(1.0), x), "negate": lambda x: -x,
    "exp": F.exp, "log": safe_ln, "sin": F.sin, "cos": F.cos, "tan": F.tan, "relu": lambda x: F.greatest(F.lit(0.0), x), "tanh": F.tanh,
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "gelu": lambda x: 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))), "none": lambda x: x,
}


def elementwise(a: ColumnLike, op: str, b: ColumnLike | float | None = None) -> Column:
    """op of each element, with the elements of b or with a number."""
    if b is None:
        return F.transform(doubles(a), UNARY[op])
    if isinstance(b, int | float):
        return F.transform(doubles(a), lambda x: BINARY[op](x, F.lit(float(b))))
    return vzip(a, b, BINARY[op])


def clamp(a: ColumnLike, low: float, high: float) -> Column:
    return F.transform(doubles(a), lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def strided(a: ColumnLike, step: int, first: int = 0) -> Column:
    return F.filter(col(a), lambda x, i: (i >= first) & ((i - first) % step == 0))


def batch_max(*columns: ColumnLike) -> Column:
    """Greatest of scalar columns; NaN yields to numbers."""
    out = col(columns[0])
    for c in columns[1:]:
        out = _max(out, col(c))
    return out


def scale(a: ColumnLike, factor: ColumnLike | float) -> Column:
    f = F.lit(float(factor)) if isinstance(factor, int | float) else col(factor)
    return F.transform(doubles(a), lambda x: x * f)


def l2_normalize(a: ColumnLike, eps: float = 1e-8) -> Column:
    """x / norm; zeros where the norm is eps or less."""
    size = norm(a)
    return F.transform(doubles(a), lambda x: F.when(size > eps, x / size).otherwise(F.lit(0.0)))


def fast_normalize(a: ColumnLike) -> Column:
    size = F.sqrt(vsum(doubles(a), lambda x: x * x) + 1e-8)
    return F.transform(doubles(a), lambda x: x / size)


def hints(a: ColumnLike, tolerance: float = 1e-4) -> Column:
    """What an index keeps beside a vector: whether it is of unit length, and its length."""
    return F.struct((F.abs(norm(a) - 1) <= tolerance).alias("is_normalized"), norm(a).alias("norm"))


def row_logsumexp(a: ColumnLike) -> Column:
    """ln of the sum of exp, stable; all -inf gives -inf, any +inf gives +inf, no element -inf."""
    d = doubles(a)
    most = F.array_max(d)
    sums = vsum(d, lambda x: F.exp(x - most))
    return F.when(d.isNull(), None).when((F.size(d) == 0) | (most == -_INF), F.lit(-_INF)).when(most == _INF, F.lit(_INF)).otherwise(most + F.ln(sums))


def row_softmax(a: ColumnLike) -> Column:
    """Shares of exp; all -inf gives zeros, +inf elements share 1."""
    d = doubles(a)
    most = F.array_max(d)
    sums = vsum(d, lambda x: F.exp(x - most))
    infinite = vsum(d, lambda x: F.when(x == _INF, F.lit(1.0)).otherwise(F.lit(0.0)))
    plain = F.transform(d, lambda x: F.exp(x - most) / sums)
    return F.when(most == -_INF, F.transform(d, lambda x: F.lit(0.0))).when(most == _INF, F.transform(d, lambda x: F.when(x == _INF, 1 / infinite).otherwise(F.lit(0.0)))).otherwise(plain)


def array_topk(a: ColumnLike, k: int, largest: bool = False) -> Column:
    """The k least (or greatest) elements as (value, index), ties by index."""
    sign = -1 if largest else 1
    pairs = F.array_sort(F.transform(doubles(a), lambda x, i: F.struct((sign * x).alias("v"), i.alias("index"))))
    return F.transform(F.slice(pairs, 1, k), lambda s: F.struct((sign * s["v"]).alias("value"), s["index"]))
