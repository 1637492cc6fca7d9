"""Scalar Column expressions. All JVM-side, so they stay inside whole-stage
codegen; no Python UDFs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or_name(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_str(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def nonblank(c: Column | str) -> Column:
    """``x IS NOT NULL AND x != ''`` (blank means missing, untrimmed)."""
    if isinstance(c, str):   # one SQL expression: one driver->JVM call
        return F.expr(f"{_ident(c)} IS NOT NULL AND {_ident(c)} != ''")
    return c.isNotNull() & (c != F.lit(""))


def norm_key(c: Column | str) -> Column:
    """Name / state matching key: ``UPPER(TRIM(x))``."""
    return F.upper(F.trim(col_or_name(c)))


def ym_from_yyyymmdd(c: Column | str) -> Column:
    """'YYYYMMDD' text -> 'YYYY-MM' text (compared with claim months as text)."""
    c = col_or_name(c)
    return F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 2))


def parse_mdy(c: Column | str) -> Column:
    """'MM/DD/YYYY' (zero padding optional) -> DATE, NULL when unparsable."""
    return F.try_to_date(col_or_name(c), "M/d/yyyy")


def mdy_to_iso(c: Column | str) -> Column:
    """'MM/DD/YYYY' -> 'YYYY-MM-DD', NULL for blank or unparsable input."""
    return F.date_format(parse_mdy(c), "yyyy-MM-dd")


def in_code_ranges(code: Column | str, ranges: Iterable[tuple[str, str]]) -> Column:
    """OR of inclusive text ranges; Catalyst pushes it into the Parquet scan."""
    ranges = list(ranges)
    if not ranges:
        return F.lit(False)
    if isinstance(code, str):
        return F.expr(" OR ".join(f"({_ident(code)} BETWEEN {_sql_str(lo)} AND {_sql_str(hi)})"
                                  for lo, hi in ranges))
    pred = None
    for lo, hi in ranges:
        term = code.between(F.lit(lo), F.lit(hi))
        pred = term if pred is None else (pred | term)
    return pred


def whole(c: Column) -> Column:
    """A DOUBLE rounded half-up (away from zero) to a whole BIGINT, as ``round`` does, without
    its decimal text per row: ``rint`` differs from it at exact ties alone."""
    near = F.rint(c)
    return F.when(F.abs(c - near) == 0.5, c + F.signum(c) * 0.5).otherwise(near).cast("bigint")


def paid_cents(c: Column | str) -> Column:
    """Money per claim row as integer cents. Sums of cents stay on 64-bit
    integers; summing DECIMAL(18,2) would widen to 28/38 digits, which Spark
    keeps in BigDecimal buffers (an order of magnitude slower per row)."""
    return whole(col_or_name(c).cast("double") * 100)


def dollars(c: Column | str) -> Column:
    """Integer cents -> DOUBLE dollars (the same correctly rounded value as
    casting the exact decimal sum)."""
    return col_or_name(c).cast("double") / F.lit(100.0)


def round4(c: Column | str) -> Column:
    """Computed doubles (ratios, averages, rates) are reported at 4 decimals,
    rounded half-up on their decimal value (via DECIMAL(38,6)), so a tie such
    as 587.46625 rounds the same in every engine instead of depending on the
    binary approximation of the double."""
    return F.round(col_or_name(c).try_cast("decimal(38,6)"), 4).cast("double")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / NULLIF(den, 0) as DOUBLE; never raises under ANSI mode."""
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def provider_name(org_name: str = "org_name", first_name: str = "first_name",
                  last_name: str = "last_name") -> Column:
    """Organisation name, else 'FIRST LAST', else 'UNKNOWN'."""
    o, f, la = _ident(org_name), _ident(first_name), _ident(last_name)
    return F.expr(f"coalesce(nullif({o}, ''), "
                  f"nullif(trim(concat_ws(' ', coalesce({f}, ''), coalesce({la}, ''))), ''), 'UNKNOWN')")


def entity_label(code: str = "entity_type") -> Column:
    """'1' -> individual, '2' -> organization, other codes pass through."""
    c = _ident(code)
    return F.expr(f"CASE {c} WHEN '1' THEN 'individual' WHEN '2' THEN 'organization' "
                  f"ELSE coalesce(nullif({c}, ''), 'unknown') END")
