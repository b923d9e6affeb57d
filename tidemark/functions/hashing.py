"""Row hashes.

``row_signature`` (XXH64, built in) is the default: any function will do as long as scans and change log use the same one. The
hashes that databases compute themselves are here for tables hashed on their side: PostgreSQL's ``hashtextextended`` and
ClickHouse's ``xxh3`` run in Arrow batches, the former vectorised over all texts of a batch at once.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DecimalType, LongType

TWO_64 = 1 << 64
UNSIGNED = DecimalType(20, 0)


def _whole(n: int) -> Column:
    return F.lit(Decimal(n)).cast(UNSIGNED)


def row_signature(text: Column) -> Column:
    """64-bit signature of a text, built in."""
    return F.xxhash64(text)


def md5_signature(text: Column) -> Column:
    """The first 60 bits of the MD5 as a positive long: the same in every database."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def unsigned(signed: Column) -> Column:
    """A signed 64-bit value's bits read as unsigned, as decimal(20,0)."""
    wide = signed.cast(UNSIGNED)
    return F.when(wide < 0, wide + _whole(TWO_64)).otherwise(wide).cast(UNSIGNED)


def signed(value: Column) -> Column:
    """The inverse of ``unsigned``."""
    half = _whole(1 << 63)
    return F.when(value >= half, value - _whole(TWO_64)).otherwise(value).cast("bigint")


def hex32(text: Column) -> Column:
    """MD5 as 32 hex digits."""
    return F.md5(text)


def hex64(text: Column) -> Column:
    """SHA-256 as 64 hex digits."""
    return F.sha2(text.cast(BinaryType()), 256)


def _rot(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint32(k)) | (x >> np.uint32(32 - k))


#: Fixed values of the hash: rotations of its mixing and closing steps.
MIX = (4, 6, 8, 16, 19, 4)
CLOSE = (14, 11, 25, 16, 4, 14, 24)
GOLDEN, EXTRA = 0x9E3779B9, 3923095


def _mix(v: list[np.ndarray]) -> list[np.ndarray]:
    a, b, c = v
    for k in MIX:  # the three words take turns
        a = (a - c) ^ _rot(c, k)
        c = c + b
        a, b, c = b, c, a
    return [a, b, c]


def _close(v: list[np.ndarray]) -> list[np.ndarray]:
    a, b, c = v
    for k in CLOSE:
        c = (c ^ b) - _rot(b, k)
        a, b, c = b, c, a
    return [c, a, b]  # seven turns have shifted the names by one


def hash_text_extended(texts: list[bytes], seed: int) -> np.ndarray:
    """PostgreSQL's 64-bit hash of each text, as signed longs.

    Texts are laid out as rows of 12-byte blocks, ordered by their number of blocks; each turn of the loop takes one block of
    all texts that still have one.
    """
    n = len(texts)
    if not n:
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, texts), np.int64, n)
    order = np.argsort(-(size // 12), kind="stable")
    size_o = size[order]
    full = size_o // 12
    with np.errstate(over="ignore"):
        start = (size_o.astype(np.uint32) + np.uint32((GOLDEN + EXTRA) % (1 << 32))).astype(np.uint32)
        state = [start.copy(), start.copy(), start.copy()]
        if seed:
            state[0] += np.uint32(seed >> 32 & 0xFFFFFFFF)
            state[1] += np.uint32(seed & 0xFFFFFFFF)
            state = _mix(state)
        data = np.frombuffer(b"".join([texts[i] for i in order.tolist()]) + bytes(12), np.uint8)
        begin = np.concatenate([[0], np.cumsum(size_o)[:-1]])
        for k in range(int(full.max())):
            m = int(np.searchsorted(-full, -k, side="left"))  # the first m texts have block k
            block = data[(begin[:m] + 12 * k)[:, None] + np.arange(12)].view("<u4").reshape(m, 3)
            part = _mix([state[i][:m] + block[:, i] for i in range(3)])
            for i in range(3):
                state[i][:m] = part[i]
        # the rest, up to 11 bytes: the third word's lowest byte stays free
        at = np.arange(11)
        left = size_o - 12 * full
        rest = np.where(at < left[:, None], data[np.minimum(begin[:, None] + 12 * full[:, None] + at, len(data) - 1)], 0).astype(np.uint8)
        room = np.zeros((n, 12), np.uint8)
        room[:, :8] = rest[:, :8]
        room[:, 9:12] = rest[:, 8:]
        words = room.view("<u4").reshape(n, 3)
        a, b, c = _close([state[i] + words[:, i] for i in range(3)])
    out = np.empty(n, np.int64)
    out[order] = (b.astype(np.uint64) << np.uint64(32) | c.astype(np.uint64)).view(np.int64)
    return out


def pg_hash(text: Column, seed: int = 1337) -> Column:
    """hashtextextended(text, seed) as a signed long; null for null."""

    @F.pandas_udf(LongType())
    def run(values):  # noqa: ANN001, ANN202
        import pandas as pd

        there = values.notna().to_numpy()
        out = pd.array(np.zeros(len(values), np.int64), dtype="Int64")
        out[~there] = pd.NA
        out[there] = hash_text_extended([v.encode() for v in values[there]], seed)
        return pd.Series(out)

    return run(text)


def xxh3(text: Column) -> Column:
    """XXH3 of the UTF-8 text, unsigned, as decimal(20,0); null for null."""

    @F.pandas_udf(LongType())
    def run(values):  # noqa: ANN001, ANN202
        import pandas as pd
        import xxhash

        half, two64 = 1 << 63, 1 << 64
        made = [None if v is None else xxhash.xxh3_64_intdigest(v.encode()) for v in values]
        return pd.Series(pd.array([None if v is None else (v - two64 if v >= half else v) for v in made], dtype="Int64"))

    return unsigned(run(text))
