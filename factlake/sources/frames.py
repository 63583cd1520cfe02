"""Framed log files: an exchange format, as a Spark data source.

A frame is its payload's length and CRC-32 (4 bytes each, little-endian), then the payload,
big-endian: seq (8 bytes), sid (16), pred (4), op (1), confidence (4), t_valid (8), idem_key (16),
the value's length (4) and the value. A file is read up to the first frame that is short or fails
its checksum, which is where a torn write ends it. Numbers beyond a bigint are refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = struct.Struct("<II")
BODY = struct.Struct(">Q16sIBfQ16sI")
SCHEMA = "seq bigint, sid bigint, pred bigint, op smallint, t_valid bigint, idem_key bigint, c float, val binary"


def encode(seq: int, sid: int, pred: int, op: int, t_valid: int, idem_key: int, c: float, val: bytes) -> bytes:
    payload = BODY.pack(seq, sid.to_bytes(16, "big"), pred, op, c, t_valid, idem_key.to_bytes(16, "big"), len(val)) + val
    return HEAD.pack(len(payload), zlib.crc32(payload)) + payload


def fitting(number: int) -> int:
    if number >= 2**63:
        raise ValueError(f"{number} doesn't fit a bigint")
    return number


def decode(data: bytes) -> Iterator[tuple]:
    """Records of the intact prefix."""
    at = 0
    while at + HEAD.size <= len(data):
        size, check = HEAD.unpack_from(data, at)
        payload = data[at + HEAD.size : at + HEAD.size + size]
        if len(payload) < size or size < BODY.size or zlib.crc32(payload) != check:
            return
        seq, sid, pred, op, c, t_valid, idem_key, n = BODY.unpack_from(payload)
        if size < BODY.size + n:
            return
        value = payload[BODY.size : BODY.size + n] if op == 0 else None
        ids = [fitting(x if isinstance(x, int) else int.from_bytes(x, "big")) for x in (seq, sid, t_valid, idem_key)]
        yield ids[0], ids[1], pred, op, ids[2], ids[3], c, value
        at += HEAD.size + size


class FrameReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as file:
            yield from decode(file.read())


class FrameSource(DataSource):
    """``spark.read.format("framelog").option("paths", "a,b").load()``: one partition per file.

    Files are opened on executors, so they must be on a folder that all of them mount.
    """

    @classmethod
    def name(cls) -> str:
        return "framelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader([p for p in self.options.get("paths", "").split(",") if p])


def read_binary(df):
    """Frames of a ``binaryFile`` DataFrame, through Spark's own readers, so from any store."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(list(decode(content)), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return df.select("content").mapInPandas(run, SCHEMA)
