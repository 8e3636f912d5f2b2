"""Personal data in free text: e-mail addresses, phone numbers, card numbers, JSON keys."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, functions as F

# What gives personal data away, and the domains that are deliberately fake.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]{2,}"
PHONE = r"\+91\d{10}"
CARD = r"\b(?:\d[ -]?){13,19}\b"
KEYS = ("email", "contact", "last4", "vpa", "card_holder_name", "customer_id", "bank_transaction_id")
FAKE_DOMAINS = ("@test.local", "@example.com", "@example.local")


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def luhn(candidate: Column) -> Column:
    """Card checksum over the digits of a candidate of 13 to 19 digits."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(candidate, r"[^0-9]", "")), ""), lambda d: d.cast("int"))
    weighted = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    )
    total = F.aggregate(weighted, F.lit(0), lambda a, d: a + d)
    return F.size(digits).between(13, 19) & (total % 10 == 0)


def emails(text: Column, allowed: tuple[str, ...] = FAKE_DOMAINS) -> Column:
    fake = lambda address: functools.reduce(operator.or_, [F.endswith(address, F.lit(d)) for d in allowed], F.lit(False))
    return F.filter(_matches(text, EMAIL), lambda address: ~fake(address))


def phones(text: Column) -> Column:
    return _matches(text, PHONE)


def card_numbers(text: Column) -> Column:
    return F.filter(_matches(text, CARD), luhn)


def forbidden_keys(text: Column) -> Column:
    """Quoted JSON keys that name personal fields."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(f'"{k}"')), F.lit(k)) for k in KEYS]))
