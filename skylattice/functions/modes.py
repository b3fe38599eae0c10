"""Decoding of Mode A/C and Mode S payloads given as lower-case hex strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the generator polynomial of the 24-bit parity.
PARITY = 0xFFF409
#: Range of latitude zones and CPR scale.
ZONES, CPR_SCALE = 15, 131072.0


def bits(hex_: Column, start: int, n: int) -> Column:
    """n bits from bit `start` (0 is the first) as a long; up to 60 bits."""
    first, last = start // 4, (start + n - 1) // 4
    v = F.conv(F.substring(hex_, first + 1, last - first + 1), 16, 10).cast("long")
    return F.shiftright(v, 4 * (last + 1) - (start + n)).bitwiseAND(F.lit((1 << n) - 1))


def parity_of(value: int, width: int) -> int:
    """Remainder of value * 2^0 by the polynomial, value being `width` bits with the parity field last."""
    full = (1 << 24) | PARITY
    for b in range(width - 1, 23, -1):
        if value >> b & 1:
            value ^= full << (b - 24)
    return value


def _residual(hex_: Column, width: int) -> Column:
    """The code is linear: the syndrome is the xor of the syndromes of the nibbles, one small table each."""
    out = F.lit(0)
    for k in range(width // 4):
        table = F.array(*[F.lit(parity_of(v << (width - 4 * k - 4), width)) for v in range(16)])
        nibble = F.conv(F.substring(hex_, k + 1, 1), 16, 10).cast("int")
        out = out.bitwiseXOR(F.get(table, nibble))
    return out


def crc24(hex_: Column) -> Column:
    """Parity residual of a 56- or 112-bit payload; null for other lengths."""
    return F.when(F.length(hex_) == 14, _residual(hex_, 56)).when(F.length(hex_) == 28, _residual(hex_, 112))


def altitude_13(field: Column) -> Column:
    """Feet from a 13-bit altitude field with the Q bit; null without."""
    low = lambda m: field.bitwiseAND(F.lit(m))
    n = F.shiftright(low(0x1F80), 2).bitwiseOR(F.shiftright(low(0x20), 1)).bitwiseOR(low(0x0F))
    return F.when(low(0x10) != 0, n * 25 - 1000)


#: Bit of the 13-bit identity field that carries each pulse, A1 A2 A4 to D4.
ID13_BITS = {"A": (11, 9, 7), "B": (5, 3, 1), "C": (12, 10, 8), "D": (4, 2, 0)}


def identity_13(field: Column) -> Column:
    """The four octal digits of a 13-bit identity field."""
    digit = lambda at: sum((F.shiftright(field, b).bitwiseAND(F.lit(1)) * w for b, w in zip(at, (1, 2, 4))), F.lit(0)).cast("int").cast("string")
    return F.concat(*[digit(ID13_BITS[k]) for k in "ABCD"])


def decode(hex_: Column) -> Column:
    """struct(df, icao, icao_source, type_code, altitude_ft, squawk, cpr_odd, cpr_lat, cpr_lon); null for other lengths."""
    df = bits(hex_, 0, 5).cast("int")
    direct = df.isin(11, 17)
    icao = F.when(direct, F.substring(hex_, 3, 6)).otherwise(F.lpad(F.lower(F.hex(crc24(hex_))), 6, "0"))
    long_ = F.length(hex_) == 28
    tc = F.when(df == 17, bits(hex_, 32, 5).cast("int"))
    airborne = (df == 17) & tc.between(9, 18) & long_
    alt12 = bits(hex_, 40, 12)
    n = F.shiftright(alt12.bitwiseAND(F.lit(0xFE0)), 1).bitwiseOR(alt12.bitwiseAND(F.lit(0xF)))
    altitude = F.when(airborne & (alt12.bitwiseAND(F.lit(0x10)) != 0), n * 25 - 1000).when(df.isin(0, 4, 16, 20), altitude_13(bits(hex_, 19, 13)))
    out = F.struct(
        df.alias("df"), icao.alias("icao"), F.when(direct, "DIRECT").otherwise("PARITY_RESIDUAL_UNVALIDATED").alias("icao_source"), tc.alias("type_code"),
        altitude.cast("int").alias("altitude_ft"), F.when(df.isin(5, 21), identity_13(bits(hex_, 19, 13))).alias("squawk"),
        F.when(airborne, bits(hex_, 53, 1) == 1).alias("cpr_odd"), F.when(airborne, bits(hex_, 54, 17)).alias("cpr_lat"), F.when(airborne, bits(hex_, 71, 17)).alias("cpr_lon"),
    )
    return F.when(F.length(hex_).isin(14, 28), out)


def mode_a(raw: Column) -> Column:
    """Octal code of a 16-bit Mode A/C word (an integer)."""
    return F.concat(*[F.shiftright(raw, s).bitwiseAND(F.lit(7)).cast("string") for s in (12, 8, 4, 0)])


def spi(raw: Column) -> Column:
    return raw.bitwiseAND(F.lit(0x80)) != 0


#: Fixed values of the altitude code: masks and what each pulse contributes.
GILLHAM_REJECT, GILLHAM_C = 0xFFFF8889, 0xF0
GILLHAM_HUNDREDS = ((0x10, 7), (0x20, 3), (0x40, 1))
GILLHAM_FIVES = ((0x2, 0xFF), (0x4, 0x7F), (0x1000, 0x3F), (0x2000, 0x1F), (0x4000, 0xF), (0x100, 7), (0x200, 3), (0x400, 1))


def gillham_value(raw: int) -> int | None:
    """Altitude in hundreds of feet of one word, null if it is no altitude code."""
    if raw & GILLHAM_REJECT or not raw & GILLHAM_C:
        return None
    ones = fives = 0
    for mask, flip in GILLHAM_HUNDREDS:
        ones ^= flip if raw & mask else 0
    if ones & 5 == 5:
        ones ^= 2
    if ones > 5:
        return None
    for mask, flip in GILLHAM_FIVES:
        fives ^= flip if raw & mask else 0
    return 5 * fives + (6 - ones if fives & 1 else ones) - 13


def gillham(raw: Column) -> Column:
    """The same as a column expression (feet / 100)."""
    has = lambda m: raw.bitwiseAND(F.lit(m)) != 0
    flip = lambda pairs: _xor([F.when(has(m), f).otherwise(0) for m, f in pairs])
    ones = flip(GILLHAM_HUNDREDS)
    ones = F.when(ones.bitwiseAND(F.lit(5)) == 5, ones.bitwiseXOR(F.lit(2))).otherwise(ones)
    fives = flip(GILLHAM_FIVES)
    value = 5 * fives + F.when(fives % 2 == 1, 6 - ones).otherwise(ones) - 13
    bad = (raw.bitwiseAND(F.lit(GILLHAM_REJECT & 0xFFFF)) != 0) | ~has(GILLHAM_C) | (ones > 5)
    return F.when(~bad, value)


def _xor(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out.bitwiseXOR(c)
    return out


def longitude_zones(lat: Column) -> Column:
    """Number of CPR longitude zones at a latitude."""
    a = F.abs(lat)
    inner = 1 - (1 - math.cos(math.pi / (2 * ZONES))) / F.pow(F.cos(F.radians(a)), 2)
    return F.when(a < 1e-10, 59).when(a > 87, 1).when(a == 87, 2).otherwise(F.floor(2 * math.pi / F.acos(F.greatest(inner, F.lit(-1.0))))).cast("int")


def global_position(even_lat: Column, even_lon: Column, odd_lat: Column, odd_lon: Column, use_odd: Column) -> Column:
    """struct(lat, lon) of an even and an odd airborne position; null if their zones differ."""
    y0, x0, y1, x1 = (c / CPR_SCALE for c in (even_lat, even_lon, odd_lat, odd_lon))
    j = F.floor(59 * y0 - 60 * y1 + 0.5)
    north = lambda d, z, y: (lambda v: F.when(v >= 270, v - 360).otherwise(v))(d * (F.pmod(j, F.lit(z)) + y))
    lat0, lat1 = north(6.0, 60, y0), north(360 / 59, 59, y1)
    nl0, nl1 = longitude_zones(lat0), longitude_zones(lat1)
    nl = F.when(use_odd, nl1).otherwise(nl0)
    ni = F.greatest(F.when(use_odd, nl - 1).otherwise(nl), F.lit(1))
    m = F.floor(x0 * (nl - 1) - x1 * nl + 0.5)
    lon = 360.0 / ni * (F.pmod(m, ni) + F.when(use_odd, x1).otherwise(x0))
    return F.when(nl0 == nl1, F.struct(F.when(use_odd, lat1).otherwise(lat0).alias("lat"), F.when(lon > 180, lon - 360).otherwise(lon).alias("lon")))


def gillham_table(spark) -> DataFrame:
    """All 65,536 words: raw, code, hundreds of feet."""
    return spark.range(65536).select(F.col("id").cast("int").alias("raw")).select("raw", mode_a(F.col("raw")).alias("code"), gillham(F.col("raw")).alias("hundreds_ft"))
