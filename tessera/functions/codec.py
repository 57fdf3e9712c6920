"""Compression of tile bytes."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = {"default": 0, "filtered": 1, "huffman_only": 2, "rle": 3, "fixed": 4}


def is_zlib(data: Column) -> Column:
    return F.coalesce((F.length(data) > 2) & F.hex(F.substring(data, 1, 2)).isin("789C", "7801", "78DA", "785E"), F.lit(False))


def is_gzip(data: Column) -> Column:
    return F.coalesce((F.length(data) > 2) & (F.hex(F.substring(data, 1, 2)) == "1F8B"), F.lit(False))


def sniff(data: Column) -> Column:
    return F.when(is_gzip(data), "gzip").when(is_zlib(data), "zlib").otherwise("none")


def compress(data: Column, gzip: bool = True, level: int = -1, strategy: str = "default") -> Column:
    if not -1 <= level <= 9:
        raise ValueError("level is from -1 to 9")
    how = STRATEGIES[strategy]

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(b):
            c = zlib.compressobj(level, zlib.DEFLATED, 31 if gzip else 15, 8, how)
            return c.compress(b) + c.flush()

        return s.map(one, na_action="ignore")

    return run(data)


def inflate(data: bytes) -> bytes:
    """Plain bytes of zlib, gzip or plain bytes."""
    if len(data) > 2 and (data[:2] == b"\x1f\x8b" or data[0] == 0x78 and data[1] in (0x9C, 0x01, 0xDA, 0x5E)):
        return zlib.decompress(data, 47)
    return data


def decompress(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: zlib.decompress(b, 47), na_action="ignore")

    return run(data)
