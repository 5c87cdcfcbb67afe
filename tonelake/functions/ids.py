"""Identifiers that must come out the same whenever a row is processed again.

SHA-256 keys of repositories and actors and the UUIDs made of hashed bytes are built-in functions, beside plain ones for
single values; only FNV-1a ids need byte work that Spark SQL lacks, a small Python function behind Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 64-bit FNV-1a parameters.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def hid(kind: str, key: Column) -> Column:
    """32 raw bytes: SHA-256 of 'repo:' or 'actor:' and the decimal id."""
    return F.unhex(F.sha2(F.concat(F.lit(f"{kind}:"), key.cast("string")), 256))


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """The keyed hash of a string column, in hex; two nested digests, so it stays in the JVM."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def challenge(secret: bytes, kind: str, subject: Column, day: Column) -> Column:
    """The hash that a subject has to publish on a day: the same all day, another one tomorrow."""
    return hmac_sha256(secret, F.concat_ws(":", F.lit(kind), subject, F.date_format(day, "yyyy-MM-dd")))


def hid_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def label(hid_column: Column, explicit: Column | None = None) -> Column:
    """The explicit label, else the first and last six hex digits."""
    h = hid_hex(hid_column)
    short = F.concat(F.substring(h, 1, 6), F.lit("..."), F.substring(h, 59, 6))
    return short if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), short)


def fnv1a64(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def synthetic_id(prefix: str, key: str | None) -> int:
    """A negative id of a name without one; 0 for no name."""
    if not key:
        return 0
    return -((fnv1a64((prefix + key).encode()) & 0x7FFFFFFFFFFFFFFF) or 1)


def stamped(digest: bytes) -> str:
    """The first 16 bytes of a digest as a version 5 UUID."""
    b = bytearray(digest[:16])
    b[6], b[8] = b[6] & 0x0F | 0x50, b[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(b)))


def zigzag(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def utterance_uuid(raw: bytes, detail: str, ordinal: int) -> str:
    return stamped(hashlib.sha256(raw + b"\x1f" + detail.lower().encode() + b"\x1f" + zigzag(ordinal)).digest())


def hit_uuid(utterance: str, term: str, category: str, severity: str, start: int, end: int) -> str:
    """The detector's version is no part of it, so a later version's equal hit replaces the earlier one."""
    named = b"".join(x.encode() + b"\0" for x in (term, category, severity))
    return stamped(hashlib.sha256(b"hit" + uuid.UUID(utterance).bytes + b"\x1f" + named + struct.pack("<ii", start, end)).digest())


def synthetic_id_col(prefix: str, key: Column) -> Column:
    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: synthetic_id(prefix, k))

    return run(key)


def _stamped_col(raw: Column) -> Column:
    """`stamped` of a SHA-256 of binary."""
    h = F.sha2(raw, 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _zigzag_col(n: Column) -> Column:
    """`zigzag` of a long."""
    n = n.cast("long")
    z = F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))
    text = F.lit("")
    for k in range(10):
        rest, more = F.shiftrightunsigned(z, 7 * k), F.shiftrightunsigned(z, 7 * k + 7) if k < 9 else F.lit(0)
        byte = F.lpad(F.hex(rest.bitwiseAND(F.lit(127)) + F.when(more != 0, 128).otherwise(0)), 2, "0")
        text = F.concat(text, byte if k == 0 else F.when(rest != 0, byte).otherwise(""))
    return F.unhex(text)


def _little_int(n: Column) -> Column:
    """The four bytes of an int, lowest first."""
    h = F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def utterance_uuid_col(raw: Column, detail: Column, ordinal: Column) -> Column:
    """`utterance_uuid` of columns; null where one of them is."""
    sep = F.lit(bytearray(b"\x1f"))
    named = F.concat(F.encode(raw, "UTF-8"), sep, F.encode(F.lower(detail), "UTF-8"), sep, _zigzag_col(ordinal))
    return F.when(named.isNotNull(), _stamped_col(named))


def hit_uuid_col(utterance: Column, term: Column, category: Column, severity: Column, start: Column, end: Column) -> Column:
    """`hit_uuid` of columns; null where one of them is."""
    parts = [F.lit(bytearray(b"hit")), F.unhex(F.replace(utterance, F.lit("-"), F.lit(""))), F.lit(bytearray(b"\x1f"))]
    for c in (term, category, severity):
        parts += [F.encode(c, "UTF-8"), F.lit(bytearray(b"\0"))]
    named = F.concat(*parts, _little_int(start), _little_int(end))
    return F.when(named.isNotNull(), _stamped_col(named))


def batch_id(ids: list[str], most: int = 64) -> int:
    """One number for a batch of ids, whatever their order: the folded digest of the smallest ones."""
    digest = hashlib.sha256(b"".join(i.encode() + b"\0" for i in sorted(ids)[:most])).digest()
    folded = 0
    for (part,) in struct.iter_unpack(">Q", digest):
        folded ^= part
    return folded
