"""Typed parameters of the detection, policy and evaluation jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

# The entity kinds, narrowest first (containment goes to the narrowest).
KINDS = ("session", "device", "network")

# Fixed value: an amount at or below this many paise counts as small.
SMALL_AMOUNT_PAISE = 5_000


@dataclass(frozen=True)
class FeatureWindow:
    """How far back features look, and how fast old attempts fade."""

    window_ms: int = 30 * MINUTE_MS
    half_life_ms: int = 5 * MINUTE_MS
    long_span_ms: int = 6 * HOUR_MS

    @property
    def lookback_ms(self) -> int:
        return max(self.window_ms, self.long_span_ms)


@dataclass(frozen=True)
class Thresholds:
    """The rule, incident, arbitration and model limits."""

    velocity_per_minute: float = 1.5
    card_spread_minimum: int = 8
    cards_per_attempt: float = 0.7
    attempts_per_card: float = 2.0
    orders_per_card_probe: int = 4
    card_spread_slow_minimum: int = 12
    approval_floor: float = 0.2
    approval_minimum_attempts: int = 6
    reason_concentration: float = 0.45
    small_amount_share: float = 0.6
    machine_cadence: float = 0.35
    cadence_minimum_attempts: int = 6
    infrastructure_share: float = 0.5
    incident_idle_ms: int = 30 * MINUTE_MS
    incident_floor: float = 0.4
    severity_high: float = 0.7
    severity_medium: float = 0.5
    arbitration_margin: float = 0.08
    containment_support: float = 0.7
    model_high_risk: float = 0.7
    model_low_risk: float = 0.15
    model_flag_risk: float = 0.8


@dataclass(frozen=True)
class ChangeOptions:
    """Change detection over per-bucket counts."""

    warm_up_buckets: int = 30
    smoothing: float = 0.2
    control_limit: float = 6.0
    slack: float = 1.5
    decision_interval: float = 12.0
    minimum_deviation: float = 0.5


@dataclass(frozen=True)
class ShopSpikeLimits:
    """When the shop as a whole looks like card testing."""

    min_attempts: int = 15
    infra_max: float = 0.3
    approval_floor: float = 0.1
    card_spread: int = 15
    min_failing_sessions: int = 5
    min_testing_sessions: int = 5


@dataclass(frozen=True)
class Policy:
    """Containment policy. Defaults are the fixed values of version 1."""

    version: int = 1
    kill_switch: bool = False
    step_up: float = 0.55
    contain: float = 0.75
    default_minutes: int = 30
    max_minutes: int = 120
    max_extensions: int = 2
    dual_approval_above_paise: int = 50_000
    containment_needs_approval: bool = True
    max_active_containments: int = 5
    max_containments_per_hour: int = 10
    max_share_of_active_sessions: float = 0.05
    share_applies_above_sessions: int = 20
    max_feature_age_minutes: int = 15
    require_confirmed_counts: bool = True
    refuse_when_abstained: bool = True
    chargeback_paise: int = 150_000
    blocked_shopper_paise: int = 120_000
    review_paise: int = 20_000
    allow_sessions: tuple[str, ...] = field(default_factory=tuple)
    allow_devices: tuple[str, ...] = field(default_factory=tuple)
    allow_networks: tuple[str, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class CostModel:
    """Cost in paise of a missed abuser and of a declined shopper."""

    false_negative: int = 500_000
    false_positive: int = 80_000
    review_cap: float = 0.03
