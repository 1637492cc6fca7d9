"""The claim rows behind a set of flags, for the file of a case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.functions.columns import dollars, paid_cents
from claimlens.sources.clustered import rows_of


def flagged_claims(claims: DataFrame, flags: DataFrame, signals: Sequence[str] | None = None) -> DataFrame:
    """All claim rows billed by providers that ``flags`` (a flag table) names, or names for
    one of ``signals``. ``claims`` had better be the layout of ``sources.clustered``: the scan
    then skips the rows of everybody else."""
    wanted = flags if signals is None else flags.where(F.col("signal_type").isin(*signals))
    return rows_of(claims, wanted.select("npi"))


def by_month_and_code(rows: DataFrame) -> DataFrame:
    """(npi, month, hcpcs_code, total_paid, total_claims) of claim rows."""
    return (rows.groupBy(F.col(S.BILLING_NPI).alias("npi"), F.col(S.CLAIM_MONTH).alias("month"), F.col(S.HCPCS).alias("hcpcs_code"))
            .agg(F.sum(paid_cents(S.TOTAL_PAID)).alias("paid"), F.sum(S.TOTAL_CLAIMS).alias("total_claims"))
            .select("npi", "month", "hcpcs_code", dollars("paid").alias("total_paid"), "total_claims"))
