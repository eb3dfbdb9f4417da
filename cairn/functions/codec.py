"""The binary frame of a mutation: CRC-32, length, then timestamp, operation, key and value, all big-endian."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME = struct.Struct(">II")
HEAD = struct.Struct(">qBHI")
#: A payload that claims more than this is damaged.
MAX_PAYLOAD = 64 << 20


def encode_entry(key: bytes, value: bytes | None, ts: int, op: int) -> bytes:
    value = value or b""
    return HEAD.pack(ts, op, len(key), len(value)) + key + value


def encode_frame(key: bytes, value: bytes | None, ts: int, op: int) -> bytes:
    body = encode_entry(key, value, ts, op)
    return FRAME.pack(zlib.crc32(body), len(body)) + body


def decode_entry(body: bytes) -> tuple[bytes, bytes | None, int, int]:
    """(key, value, ts, op); an empty value is None. Raises ValueError if the lengths do not fit."""
    if len(body) < HEAD.size:
        raise ValueError("entry is shorter than its header")
    ts, op, n_key, n_value = HEAD.unpack_from(body)
    if len(body) < HEAD.size + n_key + n_value:
        raise ValueError("entry is shorter than its lengths")
    key = body[HEAD.size : HEAD.size + n_key]
    return key, body[HEAD.size + n_key : HEAD.size + n_key + n_value] or None, ts, op


def entry_size(key: Column, value: Column) -> Column:
    """Bytes that an entry accounts for: key, value and 16."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 16).cast("long")


def checksum(data: Column) -> Column:
    """CRC-32 (IEEE) of a binary column."""
    return F.crc32(data)
