"""Byte layouts for import and export; inside the engine columns are typed.

Value of the text store: category (1 byte), amount (8 bytes, big-endian), UTF-8 text. Vector
value: header, then little-endian floats. Key: sid (16 bytes), pred (4), complement of the
sequence (8), big-endian, so that newer versions sort first. Stored value: op (1), confidence (4,
big-endian float), t_valid (8), value.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Corrupt

#: Sizes of a store value's parts, and of a stored value's fixed part.
CATEGORY_BYTES, AMOUNT_BYTES = 1, 8
VALUE_HEAD = 13

#: Tokens of any fact, and bytes of a value that are one more.
FACT_TOKENS, TOKEN_BYTES = 8, 4


def big_endian(value: Column, size: int) -> Column:
    """The low ``size`` bytes of a bigint."""
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size)) if size <= 8 else F.concat(F.unhex(F.lit("00" * (size - 8))), big_endian(value, 8))


def encode_store_value(category: Column, amount: Column, text: Column) -> Column:
    return F.concat(big_endian(category, CATEGORY_BYTES), big_endian(amount, AMOUNT_BYTES), F.encode(text, "UTF-8"))


def decode_store_value(value: Column) -> Column:
    """struct(category, amount, text); a value shorter than the header gives (0, 0, "")."""
    head = CATEGORY_BYTES + AMOUNT_BYTES
    whole = F.octet_length(value) >= head
    category = F.conv(F.hex(F.substring(value, 1, 1)), 16, 10).cast("int")
    amount = F.conv(F.hex(F.substring(value, 2, AMOUNT_BYTES)), 16, -10).cast("long")
    text = F.decode(F.substring(value, head + 1, 2**31 - 1), "UTF-8")
    return F.struct(
        F.when(whole, category).otherwise(F.lit(0)).alias("category"),
        F.when(whole, amount).otherwise(F.lit(0)).cast("long").alias("amount"),
        F.when(whole, text).otherwise(F.lit("")).alias("text"),
    )


def encode_value(op: Column, c: Column, t_valid: Column, value: Column) -> Column:
    """A stored value: op, confidence, valid time and the value (null: empty); null if any other is."""

    @F.pandas_udf("binary")
    def confidence(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if pd.isna(x) else np.array(x, dtype=">f4").tobytes())

    return F.concat(big_endian(op, 1), confidence(c), big_endian(t_valid, 8), F.coalesce(value, F.unhex(F.lit(""))))


def decode_value(stored: Column) -> Column:
    """struct(op, c, t_valid, val) of a stored value. One shorter than its fixed part stops the query."""
    short = F.octet_length(stored) < VALUE_HEAD
    checked = F.when(short, F.raise_error(F.concat(F.lit("corrupt value: "), F.octet_length(stored).cast("string"), F.lit(" bytes"))).cast("binary")).otherwise(stored)

    @F.pandas_udf("float")
    def confidence(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else np.frombuffer(x, dtype=">f4")[0])

    return F.struct(
        header_byte(checked, 0).alias("op"),
        confidence(F.substring(checked, 2, 4)).alias("c"),
        F.conv(F.hex(F.substring(checked, 6, 8)), 16, -10).cast("long").alias("t_valid"),
        F.substring(checked, VALUE_HEAD + 1, 2**31 - 1).alias("val"),
    )


def value_parts(stored: bytes) -> tuple[int, float, int, bytes]:
    """``decode_value`` of one value, on the driver; Corrupt if it is too short."""
    if len(stored) < VALUE_HEAD:
        raise Corrupt(f"a stored value has {VALUE_HEAD} bytes at least, not {len(stored)}")
    op, c, t_valid = struct.unpack(">BfQ", stored[:VALUE_HEAD])
    return op, c, t_valid, stored[VALUE_HEAD:]


def header_byte(value: Column, offset: int) -> Column:
    """The byte at an offset, 0 to 255; null past the end."""
    byte = F.substring(value, offset + 1, 1)
    return F.when(F.octet_length(byte) == 1, F.conv(F.hex(byte), 16, 10).cast("int"))


def grain_prefix(sid: Column, pred: Column) -> Column:
    return F.concat(big_endian(sid, 16), big_endian(pred, 4))


def grain_key(sid: Column, pred: Column, seq: Column) -> Column:
    return F.concat(grain_prefix(sid, pred), big_endian(F.bitwise_not(seq.cast("long")), 8))


def seq_of_key(key: Column) -> Column:
    return F.bitwise_not(F.conv(F.hex(F.substring(key, 21, 8)), 16, -10).cast("long"))


def encode_vector(header: Column, vector: Column) -> Column:
    """header + little-endian floats; null if either is null."""

    @F.pandas_udf("binary")
    def run(headers: pd.Series, vectors: pd.Series) -> pd.Series:
        both = zip(headers, vectors, strict=True)
        return pd.Series([None if h is None or v is None else h + np.asarray(v, dtype="<f4").tobytes() for h, v in both])

    return run(header, vector)


def decode_vector(value: Column, header: int, dim: int) -> Column:
    """The vector of a value, null if its length isn't header + 4 * dim."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.frombuffer(v, dtype="<f4", offset=header) if v is not None and len(v) == header + 4 * dim else None)

    return run(value)


def grain_tokens(size: Column) -> Column:
    """Token estimate of a value of ``size`` bytes: a fixed 8 plus a quarter; a tombstone has 8."""
    return (F.floor(F.coalesce(size, F.lit(0)) / TOKEN_BYTES) + FACT_TOKENS).cast("long")


def redacted(masked: Column, value: Column) -> Column:
    return F.when(masked, F.lit("[REDACTED]")).otherwise(value)
