"""All thresholds of the library in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# --- fixed values -----------------------------------------------------------
ACTIVE_SUB_EVENTS = (
    "subscription.created",
    "subscription.reactivated",
    "subscription.billing_plan_change",
    "subscription.cancellation_scheduled",
)
STARTED_SUB_EVENTS = ("subscription.created", "subscription.reactivated")
# events the subscription-state table knows about (a cancellation request still pays)
STATE_SUB_EVENTS = (
    "subscription.created",
    "subscription.reactivated",
    "subscription.billing_plan_change",
)
CHURN_SUB_EVENTS = ("subscription.canceled", "subscription.expired")
WEB_SURFACES = ("web", "landing")
PRODUCT_SURFACES = ("web", "landing", "task")
EMERGING_COUNTRIES = (
    "in", "id", "ph", "bd", "ng", "vn", "lk", "pk", "ke", "tz", "ug", "et", "gh", "mm",
)
MOBILE_UA = "Mobile|Android"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    # segment windows, days
    events_window: int = 30
    traffic_window: int = 7
    sub_event_window: int = 60
    payer_window: int = 180
    loyalty_window: int = 365
    # segment thresholds
    heavy_gb: float = 10.0
    media_requests: int = 20
    monthly_max_amount: float = 30.0
    monthly_min_txns: int = 3
    lapsed_ltv: float = 50.0
    heavy_downloads: int = 50
    power_actions: int = 100
    streamer_streams: int = 50
    streamer_max_downloads: int = 10
    # e-mail panel
    bulk_threshold: int = 1000
    era_cutover: date = date(2026, 5, 28)
    label_days: int = 14
    negative_rate: float = 0.25
    panel_start: date = date(2025, 6, 26)
    panel_end: date | None = None  # default: as_of - label_days - 1
    premium_recent_days: int = 35
    premium_annual_days: int = 370
    control_per_user: int = 3
    control_quiet_days: int = 14
    tasks_since: date = date(2026, 5, 25)
    tasks_warmup: int = 30
    subs_since: date = date(2026, 1, 12)
    mobile_window: int = 90
    panel_heavy_downloads: int = 50
    panel_streams: int = 5
    panel_dormant_days: int = 180
    panel_soft_cancel_days: int = 60
    # churn panel
    churn_start: date = date(2026, 2, 1)
    churn_step: int = 7
    churn_horizon: int = 30
    # annual plans
    annual_gap: int = 180
    annual_amount: float = 60.0
    # lifetime value
    ltv_start: date = date(2017, 1, 1)
    ltv_v1_start: date = date(2018, 1, 1)
    ltv_horizon: int = 365
    ltv_active_window: int = 730
    ltv_split: date = date(2024, 1, 1)
    # value tiers, first match wins
    tiers: tuple[tuple[str, float], ...] = (
        ("Platinum", 200.0), ("Gold", 75.0), ("Silver", 25.0),
    )
    # customer profile
    urgent_risk: float = 0.5
    urgent_ltv: float = 50.0
    vip_ltv: float = 75.0
    stall_limit: int = 5
    storage_pct: float = 80.0
    expiry_before: int = 7
    expiry_after: int = 30
    edge_window: int = 7
    task_window: int = 30
    billing_window: int = 45
    # billing rule of the churn score: risk without a payment method, after a cancellation, just before expiry
    risk_no_method: float = 0.95
    risk_cancelled: float = 0.90
    risk_expiring: float = 0.50
    cancelled_days: int = 30
    expiring_days: int = 15
    # retention quadrants (published without thresholds)
    high_value: float = 25.0
    high_risk: float = 0.3
    # win-back
    winback_window: int = 30
    winback_recent: int = 45
    winback_engagement: int = 120
    winback_vip_ltv: float = 150.0
    winback_heavy_actions: int = 50
    winback_emerging_ltv: float = 50.0
    winback_recent_web: int = 14
    # experiments
    holdout_pct: int = 10
    z_critical: float = 1.96
    # sessions
    session_gap_minutes: int = 30
    match_tolerance_seconds: int = 300
    # modelling
    top_countries: int = 30
    train_cap: int = 4_000_000  # labelled training rows a conversion model is fitted on; test rows are never capped
    seed: int = 42
    # hot-key handling
    salts: int = field(default=16)


DEFAULT = Config()
