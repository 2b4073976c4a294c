"""Masks that stay inside the JVM: keyed hashes, email and UUID layouts, an integer cipher."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(value: Column, domain: str, key: bytes) -> Column:
    """HMAC-SHA256 of ``domain|value`` as lower-case hex; null stays null."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, F.concat(F.lit(f"{domain}|"), value.cast("string")).cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def mask_email(value: Column, key: bytes) -> Column:
    return F.concat(F.substring(hmac_sha256(value, "email", key), 1, 16), F.lit("@anonymized.local"))


def mask_uuid(value: Column, key: bytes) -> Column:
    """A version 5 layout with a fixed variant digit, filled from the hash."""
    h = hmac_sha256(value, "uuid", key)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def mask_integer(value: Column, key: bytes, rounds: int = 8) -> Column:
    """A bijection of 62-bit non-negative integers: a Feistel network over 31-bit halves, each round keyed by an HMAC. Integer
    arithmetic only, so it is exact over the whole range."""
    mask = (1 << 31) - 1
    left, right = F.shiftright(value, 31), value.bitwiseAND(F.lit(mask))
    for r in range(rounds):
        mixed = F.conv(F.substring(hmac_sha256(right, f"int{r}", key), 1, 8), 16, 10).cast("bigint")
        left, right = right, left.bitwiseXOR(mixed.bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, 31) + right


def mask_columns(df, specs: dict[str, str], key: bytes):
    """Masks columns by kind: text, email, uuid, int, or null; an unknown kind counts as text."""
    made = {
        "email": lambda c: mask_email(c, key), "uuid": lambda c: mask_uuid(c, key),
        "int": lambda c: mask_integer(c.cast("bigint"), key), "null": lambda c: F.lit(None).cast("string"),
    }
    return df.withColumns({name: made.get(kind, lambda c: hmac_sha256(c, "text", key))(F.col(name)) for name, kind in specs.items()})
