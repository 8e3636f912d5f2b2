"""Keyed hashes and sealing as column expressions.

Keys given as literals appear in query plans: set ``spark.redaction.string.regex`` on the
cluster, or join the key in from a restricted one-row table and pass it as a column.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def _pads(key: str) -> tuple[str, str]:
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 in hex, from two plain SHA-256 calls."""
    inner, outer = (F.unhex(F.lit(p)) for p in _pads(key))
    first = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def pseudonymise(value: Column, key: str, version: int = 1) -> Column:
    """Keyed pseudonym of a value, prefixed with the key version; NULL stays NULL."""
    return F.concat(F.lit(f"v{version}:"), hmac_sha256(F.lower(F.trim(value)), key))


def truncate_ip(ip: Column) -> Column:
    """IPv4 to its /24, IPv6 to its /48, anything else to ``unknown``."""
    address = F.trim(ip)
    groups = F.filter(F.split(address, ":"), lambda g: g != "")
    octets = F.split(address, r"\.")
    return (
        F.when(F.contains(address, F.lit(":")), F.concat(F.array_join(F.slice(groups, 1, 3), ":"), F.lit("::/48")))
        .when(F.size(octets) == 4, F.concat(F.array_join(F.slice(octets, 1, 3), "."), F.lit(".0/24")))
        .otherwise("unknown")
    )


# Client families in the order they are looked for, with what gives them away.
UA_FAMILIES = (
    ("bot", ("bot", "crawler", "spider")),
    ("tool", ("curl", "wget", "python")),
    ("headless", ("headless",)),
    ("android", ("android",)),
    ("ios", ("iphone", "ipad")),
    ("firefox", ("firefox",)),
    ("edge", ("edg/",)),
    ("chrome", ("chrome",)),
    ("safari", ("safari",)),
)


def ua_family(user_agent: Column) -> Column:
    """Coarse client family of a user agent string."""
    text = F.lower(user_agent)
    out = F.when(F.coalesce(user_agent, F.lit("")) == "", "unknown")
    for family, needles in UA_FAMILIES:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(text, F.lit(needle))
        out = out.when(hit, family)
    return out.otherwise("other")


def seal(payload: Column, key: Column) -> Column:
    """AES-GCM sealed payload (a fresh nonce per row)."""
    return F.aes_encrypt(payload, key, F.lit("GCM"))


def unseal(sealed: Column, key: Column) -> Column:
    """Opened payload, or NULL where it was altered or the key is wrong."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string")


def data_key(secret: str) -> Column:
    """256-bit data key of one batch."""
    return F.unhex(F.lit(hashlib.sha256(secret.encode()).hexdigest()))
