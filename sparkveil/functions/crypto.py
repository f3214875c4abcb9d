"""Keys and keyed hashes.

Key bytes never become literals of a plan: they travel in a one-row table that
is joined to the data and dropped again, so neither explain() nor the event log
shows them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: HMAC block sizes and key columns.
BLOCK = {"sha256": 64, "sha512": 128}
KEYS = "_veil_keys"


@dataclass(frozen=True)
class KeyProvider:
    """Gives the key for a purpose (``hmac``, ``encrypt`` or ``pseudonym``)."""

    lookup: Callable[[str], bytes] = field(repr=False)

    @staticmethod
    def static(key: bytes) -> KeyProvider:
        return KeyProvider(lambda purpose: hashlib.sha256(purpose.encode() + b"\0" + key).digest() if purpose != "hmac" else key)

    def key(self, purpose: str) -> bytes:
        return self.lookup(purpose)


def pads(key: bytes, algorithm: str) -> tuple[bytes, bytes]:
    """The inner and outer padded keys of RFC 2104."""
    size = BLOCK[algorithm]
    if len(key) > size:
        key = hashlib.new(algorithm, key).digest()
    key = key.ljust(size, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def key_table(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    """One row with one struct of binary fields; backed by rows, not by literals."""
    fields = ", ".join(f"{k}: binary" for k in keys)
    return spark.createDataFrame(spark.sparkContext.parallelize([(tuple(keys.values()),)], 1), f"{KEYS} struct<{fields}>")


def hmac(value: Column, inner: Column, outer: Column, algorithm: str = "sha256") -> Column:
    """Hex HMAC of a string under padded keys; equals RFC 2104."""
    bits = int(algorithm[3:])
    first = F.unhex(F.sha2(F.concat(inner, F.encode(value, "utf-8")), bits))
    return F.sha2(F.concat(outer, first), bits)


def encrypt(value: Column, key: Column, context: Column) -> Column:
    """Base64 of AES-GCM; the nonce is derived from the key, the context and the value, so equal runs agree and no nonce serves two values."""
    nonce = F.unhex(F.substring(F.sha2(F.concat(key, F.encode(F.concat(context, F.lit("\0"), value), "utf-8")), 256), 1, 24))
    return F.base64(F.aes_encrypt(F.encode(value, "utf-8"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce))


def decrypt(value: Column, key: Column) -> Column:
    """What encrypt() was given, or null if it wasn't made with this key."""
    return F.try_aes_decrypt(F.unbase64(value), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")
