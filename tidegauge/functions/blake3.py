"""BLAKE3 hashes (256 bits) of strings and bytes, as the algorithm is published, for ids of artifacts and of pairs of ids.

The library that computes it fast is used where it is installed; the version here is for short payloads.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: initial values, the order in which a round's words follow, flags and sizes.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK, MASK = 64, 1024, 0xFFFFFFFF
#: Columns, then diagonals, of the four-by-four state.
LINES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv: tuple, words: tuple, counter: int, size: int, flags: int) -> tuple:
    v = [*cv, *IV[:4], counter & MASK, counter >> 32, size, flags]
    for _ in range(7):
        for n, (a, b, c, d) in enumerate(LINES):
            for word, left, right in ((words[2 * n], 16, 12), (words[2 * n + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & MASK
                x = v[d] ^ v[a]
                v[d] = (x >> left | x << 32 - left) & MASK
                v[c] = (v[c] + v[d]) & MASK
                x = v[b] ^ v[c]
                v[b] = (x >> right | x << 32 - right) & MASK
        words = tuple(words[i] for i in PERMUTATION)
    return tuple(v[i] ^ v[i + 8] for i in range(8))


def _words(block: bytes) -> tuple:
    return struct.unpack("<16I", block.ljust(BLOCK, b"\0"))


def _chunk(data: bytes, number: int, last: int) -> tuple:
    """Chaining value of a chunk; ``last``: flags of its last block."""
    cv, blocks = IV, [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
    for i, block in enumerate(blocks):
        flags = CHUNK_START * (i == 0) | (CHUNK_END | last) * (i == len(blocks) - 1)
        cv = _compress(cv, _words(block), number, len(block), flags)
    return cv


def _subtree(data: bytes, first: int, last: int) -> tuple:
    chunks = -(-len(data) // CHUNK)
    if chunks <= 1:
        return _chunk(data, first, last)
    left = 1 << (chunks - 1).bit_length() - 1  # the largest power of two with something on its right
    a, b = _subtree(data[: left * CHUNK], first, 0), _subtree(data[left * CHUNK :], first + left, 0)
    return _compress(IV, a + b, 0, BLOCK, PARENT | last)


def blake3_hex(data: bytes) -> str:
    try:
        from blake3 import blake3
    except ImportError:
        return struct.pack("<8I", *_subtree(data, 0, ROOT)).hex()
    return blake3(data).hexdigest()


def blake3_column(x: str | Column) -> Column:
    """The hash of a string's UTF-8 or of bytes, as 64 lowercase hex digits; null for null."""

    def apply(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else blake3_hex(v.encode() if isinstance(v, str) else bytes(v)) for v in values], dtype=object)

    return F.pandas_udf(apply, "string")(F.col(x) if isinstance(x, str) else x)


def merkle_node(left: str | Column, right: str | Column) -> Column:
    """The hash of two hashes' bytes, one after the other."""
    a, b = (F.unhex(F.col(x) if isinstance(x, str) else x) for x in (left, right))
    return blake3_column(F.concat(a, b))
