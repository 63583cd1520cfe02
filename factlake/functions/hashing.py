"""Hashes: FNV-1a, CRC-32, the shard router, Bloom filters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Fixed value: the factor of the shard router's mixing step.
ROUTER = 0xFF51AFD7ED558CCD
#: Fixed values of SplitMix64.
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

U64 = np.uint64


def fnv1a_bytes(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a(data: Column) -> Column:
    """FNV-1a of a binary or string column, as 16 hexadecimal digits; null stays null.

    The product is taken in two 32-bit halves, as the prime is 2**40 + 435: no overflow in ANSI mode.
    """
    codes = F.split(F.rtrim(F.regexp_replace(F.hex(data), "(..)", "$1 ")), " ")
    codes = F.filter(codes, lambda x: x != "")
    low = 0xFFFFFFFF

    def step(acc: Column, code: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(F.conv(code, 16, 10).cast("long"))
        product = lo * F.lit(435)
        high = acc["hi"] * F.lit(435) + F.shiftleft(lo, 8) + F.shiftrightunsigned(product, 32)
        return F.struct(high.bitwiseAND(F.lit(low)).alias("hi"), product.bitwiseAND(F.lit(low)).alias("lo"))

    start = F.struct(F.lit(FNV_OFFSET >> 32).alias("hi"), F.lit(FNV_OFFSET & low).alias("lo"))
    halves = F.aggregate(codes, start, step)
    return F.lower(F.concat(F.lpad(F.hex(halves["hi"]), 8, "0"), F.lpad(F.hex(halves["lo"]), 8, "0")))


def crc32(data: Column) -> Column:
    """CRC-32 (IEEE) as bigint."""
    return F.crc32(data.cast("binary"))


def times(x: Column, factor: int) -> tuple[Column, Column]:
    """(low 32 bits, the rest) of the product of a number below 2**32 with a fixed one; no step
    comes near 2**63, as the factor goes in by halves."""
    low, high = x * F.lit(factor & 0xFFFF), x * F.lit(factor >> 16)
    part = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)
    return part.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(part, 32) + F.shiftright(high, 16)


def shard_of(sid: Column, shards: int) -> Column:
    """Shard of a sid below 2**64 (its high half is 0): its bits mixed by one product between two
    shifts, modulo the shards. In two halves of 32 bits, so that nothing overflows."""
    mask = F.lit(0xFFFFFFFF)
    sid = sid.cast("long")
    mixed = sid.bitwiseXOR(F.shiftrightunsigned(sid, 33))
    low, high = mixed.bitwiseAND(mask), F.shiftrightunsigned(mixed, 32)
    a, carry = times(low, ROUTER & 0xFFFFFFFF)
    b = (carry + times(low, ROUTER >> 32)[0] + times(high, ROUTER & 0xFFFFFFFF)[0]).bitwiseAND(mask)
    a = a.bitwiseXOR(F.shiftright(b, 1))  # 33 places: the high half, once more to the right
    return F.pmod(F.pmod(b, F.lit(shards)) * F.lit(2**32 % shards) + a, F.lit(shards)).cast("long")


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x + U64(SPLITMIX[0])
    x = (x ^ (x >> U64(30))) * U64(SPLITMIX[1])
    x = (x ^ (x >> U64(27))) * U64(SPLITMIX[2])
    return x ^ (x >> U64(31))


def bloom_size(n: int, p: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for n members at false-positive rate p; at least 64 bits and one hash."""
    bits = max(64, math.ceil(-max(n, 1) * math.log(p) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def bloom_params(n: Column, p: float = 0.01) -> tuple[Column, Column]:
    """``bloom_size`` as Columns."""
    some = F.greatest(n.cast("double"), F.lit(1.0))
    bits = F.greatest(F.lit(64), F.ceil(-some * math.log(p) / math.log(2) ** 2)).cast("long")
    return bits, F.greatest(F.lit(1), F.floor(bits / some * math.log(2) + 0.5)).cast("long")


def bloom_places(sids: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Bit positions of each sid below 2**64: double hashing with the SplitMix64 of the sid and of
    its product with that generator's increment."""
    x = sids.astype(np.int64).view(U64)
    with np.errstate(over="ignore"):
        one, two = splitmix(x), splitmix(x * U64(SPLITMIX[0])) | U64(1)
        return (one[:, None] + np.arange(hashes, dtype=U64) * two[:, None]) % U64(bits)


def bloom_build(sids: np.ndarray, bits: int, hashes: int) -> bytes:
    out = np.zeros(-(-bits // 8), dtype=np.uint8)
    places = bloom_places(sids, bits, hashes).ravel()
    np.bitwise_or.at(out, (places // U64(8)).astype(np.int64), (1 << (places % U64(8)).astype(np.uint8)).astype(np.uint8))
    return out.tobytes()


def bloom_contains(bloom: bytes, sids: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Whether each sid may be a member; never false for a member."""
    data = np.frombuffer(bloom, dtype=np.uint8)
    places = bloom_places(sids, bits, hashes)
    return ((data[(places // U64(8)).astype(np.int64)] >> (places % U64(8)).astype(np.uint8)) & 1).all(axis=1)
