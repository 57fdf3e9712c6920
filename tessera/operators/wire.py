"""Reading and writing protobuf messages."""

from __future__ import annotations

import struct
from collections.abc import Iterator


class BadTile(ValueError):
    """Bytes that are no tile, or break its rules."""


def read_varint(data: bytes, i: int) -> tuple[int, int]:
    value = 0
    for shift in range(0, 70, 7):
        if i >= len(data):
            raise BadTile("end of data in a varint")
        b = data[i]
        i += 1
        value |= (b & 127) << shift
        if b < 128:
            return value & 0xFFFFFFFFFFFFFFFF, i
    raise BadTile("varint too long")


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value): whole numbers or bytes."""
    i = 0
    while i < len(data):
        key, i = read_varint(data, i)
        number, wire = key >> 3, key & 7
        if number == 0:
            raise BadTile("field number 0")
        if wire == 0:
            value, i = read_varint(data, i)
        elif wire in (1, 2, 5):
            if wire == 2:
                size, i = read_varint(data, i)
            else:
                size = 8 if wire == 1 else 4
            if i + size > len(data):
                raise BadTile("end of data in a field")
            value = data[i : i + size]
            i += size
        else:
            raise BadTile(f"wire type {wire}")
        yield number, wire, value


def packed(value: object, wire: int) -> list[int]:
    if wire == 0:
        return [value]
    out, i = [], 0
    while i < len(value):
        v, i = read_varint(value, i)
        out.append(v)
    return out


def varint(v: int) -> bytes:
    v &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def key(number: int, wire: int) -> bytes:
    return varint(number << 3 | wire)


def uint(number: int, v: int) -> bytes:
    return key(number, 0) + varint(v)


def blob(number: int, v: bytes) -> bytes:
    return key(number, 2) + varint(len(v)) + v


def packed_uints(number: int, values: list[int]) -> bytes:
    """Nothing for no values."""
    return blob(number, b"".join(map(varint, values))) if values else b""


def signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def as_float(v: bytes) -> float:
    return struct.unpack("<f", v)[0]


def as_double(v: bytes) -> float:
    return struct.unpack("<d", v)[0]
