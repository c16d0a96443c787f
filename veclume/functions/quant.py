"""Scalar and binary quantization of vectors as Columns.

Symmetric codes: q = clamp(rint(x / scale)), scale = max|x| / most. Asymmetric
codes use the whole signed range: zero point = least - rint(min / scale). Non-
finite elements: NaN counts as 0, infinities as the greatest finite float.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclume.functions.vector import ColumnLike, col, doubles, vsum, vzip

EPS = 1e-8
FLT_MAX = 3.4028234663852886e38


def finite(a: ColumnLike) -> Column:
    return F.transform(doubles(a), lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(-FLT_MAX)), F.lit(FLT_MAX))))


def symmetric_scale(a: ColumnLike, bits: int = 8) -> Column:
    most = F.array_max(F.transform(finite(a), F.abs))
    return F.greatest(most / ((1 << (bits - 1)) - 1), F.lit(EPS))


def asymmetric_scale(a: ColumnLike, bits: int = 8) -> Column:
    d = finite(a)
    return F.greatest((F.array_max(d) - F.array_min(d)) / ((1 << bits) - 1), F.lit(EPS))


def asymmetric_zero(a: ColumnLike, scale: Column, bits: int = 8) -> Column:
    return (-(1 << (bits - 1)) - F.rint(F.array_min(finite(a)) / scale)).cast("long")


def quantize(a: ColumnLike, scale: Column, zero: Column | None = None, bits: int = 8) -> Column:
    """Signed codes of bits bits, as an array of smallint."""
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    shift = F.lit(0) if zero is None else zero
    return F.transform(finite(a), lambda x: F.least(F.greatest(F.rint(x / scale) + shift, F.lit(low)), F.lit(high)).cast("smallint"))


def dequantize(q: ColumnLike, scale: Column, zero: Column | None = None) -> Column:
    shift = F.lit(0) if zero is None else zero
    return F.transform(col(q), lambda x: (x - shift) * scale)


def symmetric(a: ColumnLike, bits: int = 8) -> Column:
    """STRUCT<q, scale, zero_point> with one scale a vector."""
    scale = symmetric_scale(a, bits)
    return F.struct(quantize(a, scale, None, bits).alias("q"), scale.alias("scale"), F.lit(0).cast("long").alias("zero_point"))


def asymmetric(a: ColumnLike, bits: int = 8) -> Column:
    scale = asymmetric_scale(a, bits)
    zero = asymmetric_zero(a, scale, bits)
    return F.struct(quantize(a, scale, zero, bits).alias("q"), scale.alias("scale"), zero.alias("zero_point"))


def decode(code: ColumnLike) -> Column:
    c = col(code)
    return dequantize(c["q"], c["scale"], c["zero_point"])


def pack_nibbles(q: ColumnLike) -> Column:
    """Two 4-bit codes a byte, the first in the low bits, as an array of smallint 0..255."""
    c = col(q).cast("array<int>")
    low = F.filter(c, lambda x, i: i % 2 == 0)
    high = F.filter(c, lambda x, i: i % 2 == 1)
    return F.zip_with(low, high, lambda x, y: x.bitwiseAND(15).bitwiseOR(F.shiftleft(F.coalesce(y, F.lit(0)).bitwiseAND(15), 4)).cast("smallint"))


def unpack_nibbles(packed: ColumnLike, size: Column) -> Column:
    signed = lambda x: F.when(x > 7, x - 16).otherwise(x).cast("smallint")
    c = col(packed).cast("array<int>")
    return F.slice(F.flatten(F.transform(c, lambda x: F.array(signed(x.bitwiseAND(15)), signed(F.shiftright(x, 4).bitwiseAND(15))))), 1, size)


def binarize(a: ColumnLike, threshold: float | None = 0.0, bits: int = 32) -> Column:
    """Words of bits bits, least first: 1 where x > threshold (None: the vector's mean), as an array of bigint."""
    d = doubles(a)
    t = vsum(d) / F.size(d) if threshold is None else F.lit(float(threshold))
    words = F.sequence(F.lit(0), F.ceil(F.size(d) / bits).cast("int") - 1)

    def word(w: Column) -> Column:
        part = F.slice(d, w * bits + 1, bits)
        ones = F.transform(part, lambda x, i: F.when(x > t, F.pow(F.lit(2.0), i)).otherwise(F.lit(0.0)))
        return vsum(ones).cast("bigint")

    return F.when(F.size(d) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


def mse(a: ColumnLike, b: ColumnLike) -> Column:
    return vsum(vzip(a, b, lambda x, y: (x - y) * (x - y))) / F.size(col(a))


def max_error(a: ColumnLike, b: ColumnLike) -> Column:
    return F.array_max(vzip(a, b, lambda x, y: F.abs(x - y)))


def psnr(a: ColumnLike, error: Column) -> Column:
    """20 log10(max|x| / sqrt(mse)); an exact copy gives +inf."""
    most = F.array_max(F.transform(doubles(a), F.abs))
    return F.when(error > 0, 20 * F.log10(most / F.sqrt(F.when(error > 0, error)))).otherwise(F.lit(float("inf")))


def quality_class(p: Column) -> Column:
    return F.when(p > 40, "excellent").when(p > 30, "good").when(p > 20, "acceptable").otherwise("poor")


def compression_ratio(bits: int) -> float:
    return 32 / bits


def global_codes(df: DataFrame, vec: str, bits: int = 8, symmetric_codes: bool = False) -> tuple[DataFrame, float, int]:
    """Adds q with one scale and zero point for all rows, from one aggregation: (df, scale, zero point)."""
    least, most = df.agg(F.min(F.array_min(finite(vec))), F.max(F.array_max(finite(vec)))).first()
    if least is None:
        least = most = 0.0
    if symmetric_codes:
        scale, zero = max(max(abs(least), abs(most)) / ((1 << (bits - 1)) - 1), EPS), 0
    else:
        scale = max((most - least) / ((1 << bits) - 1), EPS)
        zero = -(1 << (bits - 1)) - round(least / scale)
    return df.withColumn("q", quantize(vec, F.lit(scale), F.lit(zero), bits)), scale, zero


def adaptive_bits(target_ratio: float) -> int:
    """Widest codes of 16, 8, 4 or 1 bits that shrink 32-bit floats by the target ratio or more."""
    return next((b for b in (16, 8, 4) if compression_ratio(b) >= target_ratio), 1)


def per_channel_scales(df: DataFrame, vec: str, bits: int = 8) -> DataFrame:
    """(i, scale) of each dimension: greatest size / most."""
    most = (1 << (bits - 1)) - 1
    return df.select(F.posexplode(finite(vec)).alias("i", "v")).groupBy("i").agg(F.greatest(F.max(F.abs("v")) / most, F.lit(EPS)).alias("scale"))


def per_channel(df: DataFrame, vec: str, bits: int = 8) -> tuple[DataFrame, list[float]]:
    """Adds q, coded with a scale a dimension: (df, scales); the scales are one aggregation and become literals."""
    scales = [r.scale for r in per_channel_scales(df, vec, bits).orderBy("i").collect()]
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    q = F.zip_with(finite(vec), F.array(*[F.lit(s) for s in scales]).cast("array<double>"), lambda x, s: F.least(F.greatest(F.rint(x / s), F.lit(low)), F.lit(high)).cast("smallint"))
    return df.withColumn("q", q), scales


def per_channel_decode(q: ColumnLike, scales: list[float]) -> Column:
    return F.zip_with(col(q), F.array(*[F.lit(s) for s in scales]).cast("array<double>"), lambda x, s: x * s)


#: Greatest size of what the stored codes take, so that code x scale stays finite.
SAFE_MAX = FLT_MAX / 256


def sanitized(a: ColumnLike) -> Column:
    """Elements in the vector's own finite range: infinities its ends, NaN 0 (within it); nothing finite: zeros."""
    d = doubles(a)
    is_finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    cut = lambda x: F.least(F.greatest(x, F.lit(-SAFE_MAX)), F.lit(SAFE_MAX))
    own = F.transform(F.filter(d, is_finite), cut)
    low, high = F.array_min(own), F.array_max(own)
    other = lambda x: F.when(F.isnan(x), F.least(F.greatest(F.lit(0.0), low), high)).when(x > 0, high).otherwise(low)
    return F.transform(d, lambda x: F.coalesce(F.when(is_finite(x), cut(x)).otherwise(other(x)), F.lit(0.0)))


def stored(a: ColumnLike, bits: int = 8, symmetric_codes: bool = True) -> Column:
    """STRUCT<q, scale, offset> with unsigned codes of 4, 8 or 16 bits, as files hold them, rounded half away from zero.

    Symmetric codes are moved up by the greatest code; others count from the
    least element. A range of zero takes the scale 1.
    """
    if bits not in (4, 8, 16):
        raise ValueError(f"codes of {bits} bits; 4, 8 or 16")
    d = sanitized(a)
    if symmetric_codes:
        most = (1 << (bits - 1)) - 1
        wide, low = F.array_max(F.transform(d, F.abs)) / most, F.lit(0.0)
    else:
        most = (1 << bits) - 1
        low = F.array_min(d)
        wide = (F.array_max(d) - low) / most
    scale = F.when(wide > 0, wide).otherwise(F.lit(1.0))
    move = most if symmetric_codes else 0
    q = F.transform(d, lambda x: (F.round(F.least(F.greatest((x - low) / scale, F.lit(float(-most if symmetric_codes else 0))), F.lit(float(most)))) + move).cast("int"))
    return F.struct(q.alias("q"), scale.alias("scale"), low.alias("offset"))


def stored_decode(code: ColumnLike, bits: int = 8, symmetric_codes: bool = True) -> Column:
    c, move = col(code), (1 << (bits - 1)) - 1 if symmetric_codes else 0
    return F.transform(c["q"], lambda x: (x - move) * c["scale"] + c["offset"])
