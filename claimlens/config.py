"""Thresholds and fixed values.

Every threshold the signals use lives in one frozen object so a run can be
re-parameterised without touching operator code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (must equal the studied system's for identical results) ---
# Home-health procedure code ranges, inclusive, compared as text.
HOME_HEALTH_CODE_RANGES: tuple[tuple[str, str], ...] = (
    ("G0151", "G0162"),
    ("G0299", "G0300"),
    ("S9122", "S9124"),
    ("T1019", "T1022"),
)

# Signal names, in run order (the order decides "first of equals" in the report).
SIGNAL_ORDER: tuple[str, ...] = (
    "excluded_provider",
    "billing_outlier",
    "rapid_escalation",
    "workforce_impossibility",
    "shared_official",
    "geographic_implausibility",
)

# Severity labels and their rank (higher = more severe).
SEVERITY_RANK: dict[str, int] = {"critical": 3, "high": 2, "medium": 1, "low": 0}

# Registry entity codes.
ENTITY_INDIVIDUAL = "1"
ENTITY_ORGANIZATION = "2"

# Sentinels that mean "missing" in the exclusion list.
MISSING_NPI_VALUES = ("", "0000000000")
MISSING_REINSTATEMENT_VALUES = ("", "0", "00000000")

TOOL_VERSION = "claimlens 0.1.0"


@dataclass(frozen=True)
class SignalConfig:
    # billing outlier (peer groups: taxonomy x state)
    min_peers: int = 10
    median_quantile: float = 0.50
    outlier_quantile: float = 0.99
    # "exact" = exact percentile (linear interpolation) by a distributed
    #   selection; on request "builtin" (a group's values in one task) and
    #   "approx" (percentile_approx sketch, bounded memory, one pass) or
    #   "sketch" (KLL: stored, merged upwards, see functions/sketches.py)
    quantile_method: str = "exact"
    approx_accuracy: int = 10000
    # rapid escalation
    enumeration_window_months: int = 24
    first_billed_months: int = 12
    rolling_rows: int = 3
    growth_lag_rows: int = 3
    min_growth_rank: int = 6
    growth_pct_threshold: float = 200.0
    # workforce impossibility
    work_days_per_month: float = 22.0
    work_hours_per_day: float = 8.0
    max_claims_per_hour: float = 6.0
    # shared official
    min_official_npis: int = 5
    min_official_combined_paid: float = 1_000_000.0
    # home health
    min_monthly_claims: int = 100
    max_bene_ratio: float = 0.1
    code_ranges: tuple[tuple[str, str], ...] = field(default=HOME_HEALTH_CODE_RANGES)
    # severity cut-offs
    outlier_high_ratio: float = 5.0
    escalation_high_pct: float = 500.0
    official_high_paid: float = 5_000_000.0
    home_health_high_ratio: float = 0.05
    # excluded provider: the studied system sums the billing and servicing
    # legs, so a row whose two NPIs are the same excluded provider counts
    # twice, and once more for every further exclusion that covers its month. True
    # counts each claim row once.
    count_rows_once: bool = False

    @property
    def hours_per_month(self) -> float:
        return self.work_days_per_month * self.work_hours_per_day

    @property
    def max_claims_per_month(self) -> float:
        # 6 claims/h x 176 h = 1056 claims
        return self.max_claims_per_hour * self.hours_per_month


DEFAULT_CONFIG = SignalConfig()
