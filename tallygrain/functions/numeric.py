"""Numbers, bits and vectors as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallygrain import constants as C


def half_up(x: Column) -> Column:
    """Round halves toward plus infinity: -2.5 gives -2, 2.5 gives 3."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, null when there is nothing to divide by."""
    return F.when(whole > 0, half_up(part * F.lit(100.0) / whole)).cast("long")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * C.EARTH_KM) * F.asin(F.sqrt(chord))


def tile_id(lat: Column, lon: Column) -> Column:
    """Grid cell of a point, hundredths of a degree."""
    return F.concat(
        F.lit("T"), half_up(lat * 100).cast("long").cast("string"), half_up(lon * 100).cast("long").cast("string")
    )


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter of the two lengths, in double precision."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(
        F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def round_vector(v: Column, digits: int = 5) -> Column:
    scale = float(10**digits)
    return F.transform(v, lambda x: half_up(x.cast("double") * scale) / F.lit(scale))


def round_to(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return half_up(x * scale) / F.lit(scale)


def bits_high(p_hash: Column) -> Column:
    """First 32 bits of a 64-character bit string, as a long."""
    return F.conv(F.substring(p_hash, 1, 32), 2, 10).cast("long")


def bits_low(p_hash: Column) -> Column:
    return F.conv(F.substring(p_hash, 33, 32), 2, 10).cast("long")


def bit_text(hi: Column, lo: Column) -> Column:
    """The bit string of two 32-bit halves."""
    half = lambda x: F.lpad(F.bin(x), 32, "0")
    return F.concat(half(hi), half(lo))


def is_bit_hash(p_hash: Column) -> Column:
    """One look at the text: 64 characters, all 0 or 1; null is no hash."""
    return F.coalesce(p_hash.rlike(f"^[01]{{{C.PHASH_BITS}}}$"), F.lit(False))


def hamming_halves(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))


def hamming(a: Column, b: Column) -> Column:
    """Bit distance; strings of different length count as 64 apart."""
    comparable = is_bit_hash(a) & is_bit_hash(b)
    return F.when(comparable, hamming_halves(bits_high(a), bits_low(a), bits_high(b), bits_low(b))).otherwise(
        F.lit(C.PHASH_BITS)
    )
