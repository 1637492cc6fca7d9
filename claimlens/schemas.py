"""Column names and schemas of the three domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

# spending (claims fact)
BILLING_NPI = "BILLING_PROVIDER_NPI_NUM"
SERVICING_NPI = "SERVICING_PROVIDER_NPI_NUM"
CLAIM_MONTH = "CLAIM_FROM_MONTH"
HCPCS = "HCPCS_CODE"
TOTAL_CLAIMS = "TOTAL_CLAIMS"
TOTAL_PAID = "TOTAL_PAID"
TOTAL_BENES = "TOTAL_UNIQUE_BENEFICIARIES"

MONEY = T.DecimalType(18, 2)

SPENDING_SCHEMA = T.StructType([
    T.StructField(BILLING_NPI, T.StringType()),
    T.StructField(SERVICING_NPI, T.StringType()),
    T.StructField(CLAIM_MONTH, T.StringType()),
    T.StructField(HCPCS, T.StringType()),
    T.StructField(TOTAL_CLAIMS, T.LongType()),
    T.StructField(TOTAL_PAID, MONEY),
    T.StructField(TOTAL_BENES, T.LongType()),
])

# --- fixed values: registry column headers of the public NPI registry file,
# and the short names the signals use, in file order ---
REGISTRY_COLUMNS: tuple[tuple[str, str], ...] = (
    ("NPI", "npi"),
    ("Entity Type Code", "entity_type"),
    ("Provider Organization Name (Legal Business Name)", "org_name"),
    ("Provider Last Name (Legal Name)", "last_name"),
    ("Provider First Name", "first_name"),
    ("Provider Business Practice Location Address State Name", "state"),
    ("Provider Business Practice Location Address Postal Code", "postal_code"),
    ("Healthcare Provider Taxonomy Code_1", "taxonomy"),
    ("Provider Enumeration Date", "enumeration_date"),
    ("Authorized Official Last Name", "auth_off_last"),
    ("Authorized Official First Name", "auth_off_first"),
)
REGISTRY_LONG = tuple(long for long, _ in REGISTRY_COLUMNS)
REGISTRY_SHORT = tuple(short for _, short in REGISTRY_COLUMNS)

REGISTRY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REGISTRY_SHORT])

# exclusion list, all text
EXCLUSION_COLUMNS = ("LASTNAME", "FIRSTNAME", "MIDNAME", "NPI", "EXCLTYPE",
                     "EXCLDATE", "REINDATE", "STATE", "SPECIALTY")
EXCLUSION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EXCLUSION_COLUMNS])
