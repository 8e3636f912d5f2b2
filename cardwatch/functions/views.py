"""Presentation columns: titles, reasons, short references, statuses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _any_of(fired: Column, *rules: str) -> Column:
    return F.arrays_overlap(fired, F.array(*[F.lit(r) for r in rules]))


_SPREAD = ("card_spread", "card_spread_slow", "card_probing")


def incident_title(kind: Column, best: Column, fired: Column) -> Column:
    """Short title: card evidence first, then the attack explanation, then single signals."""
    network, attack = kind == "network", best == "attack"
    # The titles.
    return (
        F.when(_any_of(fired, *_SPREAD) & network, "Distributed card testing")
        .when(_any_of(fired, *_SPREAD), "Coordinated card testing")
        .when(attack & (kind == "device"), "Suspicious device activity")
        .when(attack & network, "Distributed card testing")
        .when(attack, "Suspicious payment activity")
        .when(_any_of(fired, "small_amount_probing"), "Unusual amount pattern")
        .when(_any_of(fired, "velocity", "machine_cadence"), "Velocity spike detected")
        .when(_any_of(fired, "approval_collapse", "reason_mix"), "Multiple declines")
        .when(best == "retry_storm", "Repeated retries")
        .when(best == "outage", "Gateway failures")
        .otherwise("Unusual payment activity")
    )


def reason_for(kind: Column, fired: Column) -> Column:
    """One sentence on why the attempts were grouped."""
    spread = _any_of(fired, *_SPREAD)
    # The sentences.
    return (
        F.when(spread & (kind == "device"), "One device attempted many distinct cards in a short window.")
        .when(spread & (kind == "network"), "Many distinct cards were tried across sessions from one network.")
        .when(spread, "One checkout session cycled through many distinct cards.")
        .when(_any_of(fired, "velocity", "machine_cadence"), "Payments arrived faster and more evenly than a person checking out.")
        .when(_any_of(fired, "approval_collapse", "reason_mix"), "A run of declines well below this shop’s normal approval rate.")
        .when(_any_of(fired, "small_amount_probing"), "Repeated very-small-amount attempts, the shape of card validation.")
        .otherwise("Several correlated attempts from one entity formed a pattern.")
    )


def display_status(status: Column, recovered: Column) -> Column:
    return (
        F.when(status == "captured", F.when(recovered, "recovered").otherwise("captured"))
        .when(status.isin("failed", "authorized", "refunded"), status)
        .otherwise("pending")
    )


def classify_amount(typical: Column, amount: Column) -> Column:
    """Amount against the shop's typical capture, in a wide band."""
    return (
        F.when(typical.isNull() | amount.isNull(), "unknown")
        .when(amount < typical * 0.5, "below")
        .when(amount > typical * 1.5, "above")
        .otherwise("typical")
    )


def risk_bucket(severity: Column, score: Column) -> Column:
    return F.when((severity == "high") & (score >= 0.9), "critical").otherwise(severity)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)


def fingerprint(pseudonym: Column) -> Column:
    """First 8 characters of a pseudonym without its key version."""
    return F.substring(F.regexp_replace(pseudonym, r"^v\d+:", ""), 1, 8)


def card_token(card_id: Column) -> Column:
    """Last 8 characters of a card token: tokens share a prefix, so the tail tells them apart."""
    return F.right(F.regexp_replace(card_id, r"^v\d+:", ""), F.lit(8))


def incident_ref(incident_id: Column) -> Column:
    return F.concat(F.lit("INC-"), F.upper(F.substring(F.regexp_replace(incident_id, "-", ""), 1, 4)))
