"""Report text per signal, as a 6-row dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: legal claim type, statute reference and suggested next
# steps per signal; they must match the studied report text exactly ---
CLAIM_TYPES = {
    "excluded_provider": "Presenting false claims — excluded provider cannot legally bill federal healthcare programs",
    "billing_outlier": "Potential overbilling — provider billing far exceeds peer group norms suggesting inflated or fabricated claims",
    "rapid_escalation": "Potential bust-out scheme — new entity with explosive billing growth consistent with fraud-and-flee pattern",
    "workforce_impossibility": "False records — billing volume physically impossible for reported workforce, implying fabricated claims",
    "shared_official": "Conspiracy — coordinated billing through multiple entities controlled by same individual suggests shell company network",
    "geographic_implausibility": "Reverse false claims — repeated billing on same patients with implausible geographic patterns",
}

STATUTES = {
    "excluded_provider": "31 U.S.C. § 3729(a)(1)(A)",
    "billing_outlier": "31 U.S.C. § 3729(a)(1)(A)",
    "rapid_escalation": "31 U.S.C. § 3729(a)(1)(A)",
    "workforce_impossibility": "31 U.S.C. § 3729(a)(1)(B)",
    "shared_official": "31 U.S.C. § 3729(a)(1)(C)",
    "geographic_implausibility": "31 U.S.C. § 3729(a)(1)(G)",
}

NEXT_STEPS = {
    "excluded_provider": [
        "Verify exclusion status on OIG LEIE website and confirm NPI match",
        "Request payment records from state Medicaid agency for the post-exclusion period",
        "Initiate recovery action for all payments made after exclusion date",
        "Refer to OIG for potential criminal prosecution under 42 U.S.C. § 1320a-7b",
    ],
    "billing_outlier": [
        "Request detailed claims data and supporting documentation from provider",
        "Compare service patterns against peer group norms for the same taxonomy and state",
        "Conduct desk audit of highest-volume service codes",
        "Consider on-site audit if billing exceeds 5x peer median",
    ],
    "rapid_escalation": [
        "Review provider enrollment application and supporting documentation",
        "Analyze service code distribution for patterns consistent with upcoding",
        "Interview beneficiaries to verify services were rendered",
        "Place provider on prepayment review if growth exceeds 500%",
    ],
    "workforce_impossibility": [
        "Request organizational staffing records and provider schedules",
        "Cross-reference NPI sub-parts and rendering providers",
        "Analyze time-of-day claim patterns for statistical impossibilities",
        "Conduct unannounced site visit to verify staffing levels",
    ],
    "shared_official": [
        "Map all NPIs controlled by the authorized official and their corporate relationships",
        "Analyze billing patterns across all controlled entities for coordination",
        "Review state corporate filings for common ownership structures",
        "Investigate for potential kickback or self-referral arrangements",
    ],
    "geographic_implausibility": [
        "Map beneficiary addresses against provider service area",
        "Review travel logs and service delivery documentation",
        "Interview a sample of beneficiaries to verify services received",
        "Analyze GPS data from electronic visit verification systems if available",
    ],
}

DIM_SCHEMA = T.StructType([
    T.StructField("signal_type", T.StringType(), False),
    T.StructField("claim_type", T.StringType(), False),
    T.StructField("statute_reference", T.StringType(), False),
    T.StructField("next_steps", T.ArrayType(T.StringType(), False), False),
])


def signal_dimension(spark: SparkSession) -> DataFrame:
    """6 rows (fixed size, safe to broadcast)."""
    rows = [(name, CLAIM_TYPES[name], STATUTES[name], NEXT_STEPS[name]) for name in CLAIM_TYPES]
    return spark.createDataFrame(rows, DIM_SCHEMA)
