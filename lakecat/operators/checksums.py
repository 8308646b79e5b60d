"""Digests of contents and the algebra of cyclic checksums.

MD5, SHA and CRC-32 are Spark's own. CRC-32C and CRC-64/NVME have no built-in: a table-driven fold over all rows of a batch at once. The
checksum of joined contents comes from the parts' checksums and lengths alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reflected polynomials by width.
POLYNOMIALS = {"crc32": (32, 0xEDB88320), "crc32c": (32, 0x82F63B78), "crc64nvme": (64, 0x9A6C9329AC4BC9B5)}


@functools.cache
def _table(kind: str) -> np.ndarray:
    _, poly = POLYNOMIALS[kind]
    out = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        out = np.where(out & np.uint64(1), (out >> np.uint64(1)) ^ np.uint64(poly), out >> np.uint64(1))
    return out


def crc(kind: str, data: list[bytes]) -> np.ndarray:
    """Checksums of many byte strings side by side: one step per byte position, over all strings that reach it."""
    width, _ = POLYNOMIALS[kind]
    table, ones = _table(kind), np.uint64((1 << width) - 1)
    order = np.argsort([-len(x) for x in data], kind="stable")
    sizes = np.array([len(data[i]) for i in order], np.int64)
    buffer = np.frombuffer(b"".join(data[i] for i in order), np.uint8)
    begin = np.cumsum(sizes) - sizes
    state = np.full(len(data), ones)
    for at in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -at, "left"))
        byte = buffer[begin[:n] + at]
        state[:n] = table[((state[:n] ^ byte) & np.uint64(0xFF)).astype(np.int64)] ^ (state[:n] >> np.uint64(8))
    out = np.empty(len(data), np.uint64)
    out[order] = state ^ ones
    return out


def combine(kind: str, first: int, second: int, second_size: int) -> int:
    """Checksum of two strings joined."""
    width, poly = POLYNOMIALS[kind]
    # the map that one zero bit makes, as the image of each bit; squaring it doubles the number of bits
    step = [poly] + [1 << i for i in range(width - 1)]

    def apply(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    bits = 8 * second_size
    while bits:
        if bits & 1:
            first = apply(step, first)
        step = [apply(step, x) for x in step]
        bits >>= 1
    return first ^ second


def crc_column(kind: str):
    """Arrow-batched function from binary to the checksum as a lower-case hex string."""
    digits = POLYNOMIALS[kind][0] // 4

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([f"{int(x):0{digits}x}" for x in crc(kind, [bytes(v) if v is not None else b"" for v in values])])

    return run


def digests(blobs: DataFrame, content: str = "content") -> DataFrame:
    """blobs with md5, sha1, sha256 and crc32 in hex, all in the JVM."""
    data = F.col(content).cast("binary")
    return blobs.withColumns({"md5": F.md5(data), "sha1": F.sha1(data), "sha256": F.sha2(data, 256), "crc32": F.lower(F.lpad(F.hex(F.crc32(data)), 8, "0"))})


def full_object(parts: DataFrame, kind: str) -> DataFrame:
    """Per object: the checksum of the whole from (part_number, checksum in hex, size) of its parts, a left fold in order."""
    lists = parts.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("part_number", "checksum", "size"))).alias("parts"))
    digits = POLYNOMIALS[kind][0] // 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for rows in frame["parts"]:
                value, *rest = [(int(r["checksum"], 16), r["size"]) for r in rows]
                value = value[0]
                for other, size in rest:
                    value = combine(kind, value, other, size)
                out.append(f"{value:0{digits}x}")
            yield pd.DataFrame({"object_id": frame["object_id"], "checksum": out})

    return lists.mapInPandas(run, "object_id long, checksum string")


def base64_of(hex_digest: Column) -> Column:
    return F.base64(F.unhex(hex_digest))
