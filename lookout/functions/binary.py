"""Functions of bytes: MurmurHash3, image kinds, compressed and encoded bodies."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_U = 0xFFFFFFFF


def _rotl(x: int, n: int) -> int:
    return ((x << n) | (x >> (32 - n))) & _U


def murmur3(data: bytes, seed: int = 0) -> int:
    """The public MurmurHash3_x86_32, as a signed int."""
    mixed = lambda k: _rotl(k * 0xCC9E2D51 & _U, 15) * 0x1B873593 & _U
    whole = len(data) // 4 * 4
    h = seed
    for k in np.frombuffer(data, "<u4", whole // 4).tolist():
        h = (_rotl(h ^ mixed(k), 13) * 5 + 0xE6546B64) & _U
    h ^= mixed(int.from_bytes(data[whole:], "little")) ^ len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> shift)) * factor & _U
    return h - (1 << 32) if h >> 31 else h


def favicon_hash(data: bytes | None) -> int | None:
    """MurmurHash3 of the base64 text in lines of 76 characters."""
    return None if data is None else murmur3(base64.encodebytes(data))


def favicon_hash_udf():
    def batch(bodies: pd.Series) -> pd.Series:
        return bodies.map(favicon_hash).astype("Int32")

    return F.pandas_udf(batch, "int")


def image_kind(data: Column) -> Column:
    """png, jpeg, gif, ico or webp by the first bytes; null for others."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("474946383761") | head.startswith("474946383961"), "gif").when(head.startswith("00000100"), "ico").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")


def inflated(data: bytes | None, encoding: str | None, most: int) -> tuple[bytes | None, str]:
    """(body, ok | truncated | corrupt | kept) of a content encoding, never more than ``most`` bytes."""
    if data is None:
        return None, "missing"
    kind = (encoding or "identity").strip().lower()
    if kind in ("identity", ""):
        return data[:most], "truncated" if len(data) > most else "ok"
    if kind not in ("gzip", "x-gzip", "deflate"):
        return data, "kept"
    for bits in (47, -15) if kind == "deflate" else (31,):
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(data, most + 1)
        except zlib.error:
            continue
        return out[:most], "truncated" if len(out) > most or not d.eof else "ok"
    return None, "corrupt"


def inflate_udf(most: int = 10 << 20):
    def batch(bodies: pd.Series, encodings: pd.Series) -> pd.DataFrame:
        rows = [inflated(None if b is None else bytes(b), e, most) for b, e in zip(bodies, encodings, strict=True)]
        return pd.DataFrame(rows, columns=["body", "state"])

    return F.pandas_udf(batch, "body binary, state string")


def text_of(data: bytes | None, charset: str | None) -> str | None:
    """Bytes as text in the named charset, else UTF-8, broken characters replaced."""
    if data is None:
        return None
    try:
        return data.decode(charset or "utf-8", "replace")
    except (LookupError, UnicodeError):
        return data.decode("utf-8", "replace")


def decode_udf():
    def batch(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
        return pd.Series([text_of(None if b is None else bytes(b), c) for b, c in zip(bodies, charsets, strict=True)], dtype=object)

    return F.pandas_udf(batch, "string")
