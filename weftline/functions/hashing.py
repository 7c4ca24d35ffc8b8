"""Digests. Those that Spark has stay in the JVM; MD4-based and Python-2 hashes run as Arrow batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ED2K_CHUNK = 9_728_000


def digest(data: Column, name: str) -> Column:
    """Hex digest by md5, sha1, sha224, sha256, sha384 or sha512."""
    if name == "md5":
        return F.md5(data)
    if name == "sha1":
        return F.sha1(data)
    sizes = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}
    if name not in sizes:
        raise ValueError(f"no digest {name}")
    return F.sha2(data, sizes[name])


def crc32_hex(data: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.crc32(data)), 8, "0"))


def sum_line(hex_digest: Column, path: Column) -> Column:
    return F.concat(hex_digest, F.lit(" *"), path)


def hash_of_json(value: Column) -> Column:
    """md5 of a value's JSON text."""
    return F.md5(F.to_json(value))


def md4(data: bytes) -> bytes:
    mask = 0xFFFFFFFF

    def turn(x: int, n: int) -> int:
        x &= mask
        return (x << n | x >> (32 - n)) & mask

    state = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    padded = data + b"\x80" + b"\0" * ((55 - len(data)) % 64) + struct.pack("<Q", 8 * len(data))
    orders = (range(16), [i for k in range(4) for i in range(k, 16, 4)], [0, 8, 4, 12, 2, 10, 6, 14, 1, 9, 5, 13, 3, 11, 7, 15])
    mixes = (lambda x, y, z: x & y | ~x & z, lambda x, y, z: x & y | x & z | y & z, lambda x, y, z: x ^ y ^ z)
    for at in range(0, len(padded), 64):
        block, (a, b, c, d) = struct.unpack_from("<16I", padded, at), state
        for order, mix, add, turns in zip(orders, mixes, (0, 0x5A827999, 0x6ED9EBA1), ((3, 7, 11, 19), (3, 5, 9, 13), (3, 9, 11, 15)), strict=True):
            for k, i in enumerate(order):
                a, b, c, d = d, turn(a + mix(b, c, d) + block[i] + add, turns[k % 4]), b, c
        state = [(x + y) & mask for x, y in zip(state, (a, b, c, d), strict=True)]
    return struct.pack("<4I", *state)


def ed2k(data: bytes, end_block: bool = False) -> str:
    """The chunked MD4 of a file; end_block adds an empty chunk after an exact multiple."""
    chunks = [data[i : i + ED2K_CHUNK] for i in range(0, len(data), ED2K_CHUNK)] or [b""]
    if end_block and data and len(data) % ED2K_CHUNK == 0:
        chunks.append(b"")
    return md4(chunks[0]).hex() if len(chunks) == 1 else md4(b"".join(map(md4, chunks))).hex()


@F.pandas_udf(T.StringType())
def ed2k_hex(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else ed2k(bytes(b)))


def string_hash(text: str, bits: int = 64) -> int:
    """The signed multiplicative string hash of Python 2."""
    mask = (1 << bits) - 1
    if not text:
        return 0
    x = ord(text[0]) << 7
    for ch in text:
        x = (1000003 * x ^ ord(ch)) & mask
    x = (x ^ len(text)) & mask
    x = x - (1 << bits) if x >> (bits - 1) else x
    return -2 if x == -1 else x


@F.pandas_udf(T.LongType())
def string_hash_64(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else string_hash(t))
