"""Keyed hashes and name-based ids, as built-in expressions."""

import hashlib
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_hop(forwarded: Column) -> Column:
    """The first address of a forwarded-for list."""
    return F.btrim(F.element_at(F.split(forwarded, ","), 1))


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex; empty for an empty message."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.when(message == "", "").otherwise(F.sha2(F.concat(outer, digest), 256))


def uuid5(space: UUID, name: Column) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.lit(space.bytes), name.cast("binary")))
    cut = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(cut(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))
