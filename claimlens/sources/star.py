"""Map the driver's TPC-H-like star onto the three domain tables.

One lineitem is one claim row: billed by the order's customer, serviced by
the line's supplier, in the ship month. Customers double as registry
providers and, for every 29th key, as excluded providers. The exclusion list
is produced in *raw* form (padded, mixed case, sentinel values) and goes
through the same normalisation as a real CSV ingest.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.functions.columns import whole
from claimlens.sources.ingest import normalize_exclusions
from claimlens.sources.tables import ClaimsTables, registry_view

PAID_FACTOR = Decimal("0.035")

# Declared read schemas (only the columns the mapping uses): no footer-reading
# schema-inference job per read, and the scans' ReadSchema is exactly these.
STAR_SCHEMAS: dict[str, str] = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                "l_extendedprice double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def npi_from_key(key: Column) -> Column:
    """'1' followed by the key padded to 9 digits; for keys of up to 9 digits, the text of
    one sum."""
    return (F.when(key.between(0, 999_999_999), (key + 1_000_000_000).cast("string"))
             .otherwise(F.concat(F.lit("1"), F.lpad(key.cast("string"), 9, "0"))))


def money_from_cents(cents: Column) -> Column:
    """Integer cents -> MONEY. Up to 15 digits the product is exact in 64 bits, and no double
    goes through its decimal text."""
    return (F.when(F.abs(cents) < 10 ** 15, (cents.cast("decimal(15,0)") * F.lit(Decimal("0.01"))).cast(S.MONEY))
             .otherwise((cents / F.lit(100.0)).cast(S.MONEY)))


def spending_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # a hash table of the orders of one shuffle partition; neither side is sorted
    j = li.join(orders.hint("shuffle_hash"), li.l_orderkey == orders.o_orderkey)
    part_mod = F.col("l_partkey") % 8
    code = (F.when(part_mod == 0, "G0151").when(part_mod == 1, "G0299")
             .when(part_mod == 2, "S9122").when(part_mod == 3, "T1019").otherwise("99213"))
    cust_mod = F.col("o_custkey") % 7
    bene_factor = F.when(cust_mod == 0, 0.5).when(cust_mod == 1, 1.5).otherwise(4.0)
    # price in cents x 0.035, rounded half-up to cents, in exact integer
    # arithmetic (a decimal(18,2) x decimal(3,3) product needs 22 digits,
    # which leaves Spark's compact 64-bit decimal path)
    cents = whole(F.col("l_extendedprice") * 100)
    factor_milli = int(PAID_FACTOR * 1000)   # 35
    paid_cents = F.floor((cents * factor_milli + 500) / F.lit(1000)).cast("bigint")
    paid = money_from_cents(paid_cents)
    return j.select(
        npi_from_key(F.col("o_custkey")).alias(S.BILLING_NPI),
        npi_from_key(F.col("l_suppkey")).alias(S.SERVICING_NPI),
        F.date_format(F.col("l_shipdate"), "yyyy-MM").alias(S.CLAIM_MONTH),
        code.alias(S.HCPCS),
        (F.col("l_quantity").cast("bigint") * 20).alias(S.TOTAL_CLAIMS),
        paid.alias(S.TOTAL_PAID),
        F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("l_quantity") * bene_factor))
         .cast("bigint").alias(S.TOTAL_BENES),
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, F.col("n_regionkey") == r.r_regionkey))


def registry_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry with the long public headers (renamed by ``registry_view``)."""
    k = F.col("c_custkey")
    is_org = (k % 3) == 0
    last_base = F.concat(F.lit("LAST"), (k % 97).cast("string"))
    last = F.when(k % 2 == 0, F.lower(last_base)).otherwise(F.concat(F.lit(" "), last_base, F.lit(" ")))
    enum_date = F.date_sub(F.lit("1995-01-02").cast("date"), ((k * 7) % 1100).cast("int"))
    off_last = F.when(k % 120 < 60, F.concat(F.lit("OFF"), (k % 120).cast("string"))) \
                .otherwise(F.concat(F.lit("OFF"), k.cast("string")))
    none = F.lit(None).cast("string")
    values = {
        "npi": npi_from_key(k),
        "entity_type": F.when(is_org, F.lit("2")).otherwise(F.lit("1")),
        "org_name": F.when(is_org, F.col("c_name")).otherwise(none),
        "last_name": last,
        "first_name": F.concat(F.lit("FIRST"), k.cast("string")),
        "state": F.col("r_name"),
        "postal_code": F.lpad((k % 100000).cast("string"), 5, "0"),
        "taxonomy": F.col("c_mktsegment"),
        "enumeration_date": F.date_format(enum_date, "MM/dd/yyyy"),
        "auth_off_last": F.when(is_org, off_last).otherwise(none),
        "auth_off_first": F.when(is_org, F.lit("A")).otherwise(none),
    }
    return _customers(spark, sf_dir).select(
        *[values[short].alias(long) for long, short in S.REGISTRY_COLUMNS])


def exclusions_raw_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw exclusion records as a CSV would carry them: padded mixed-case
    names, '0000000000' for a missing NPI, '00000000' for no reinstatement."""
    k = F.col("c_custkey")
    even = (k % 2) == 0
    return (_customers(spark, sf_dir).where(k % 29 == 0).select(
        F.concat(F.lit("  Last"), (k % 97).cast("string"), F.lit(" ")).alias("LASTNAME"),
        F.concat(F.lit(" First"), k.cast("string")).alias("FIRSTNAME"),
        F.when(even, F.lit(" m ")).otherwise(F.lit("")).alias("MIDNAME"),
        F.when(even, F.concat(F.lit(" "), npi_from_key(k))).otherwise(F.lit("0000000000")).alias("NPI"),
        F.lit(" 1128a1").alias("EXCLTYPE"),
        F.when(k % 5 == 0, F.lit("19980601")).otherwise(F.lit("19970315")).alias("EXCLDATE"),
        F.when(k % 3 == 0, F.lit("20000101")).otherwise(F.lit("00000000")).alias("REINDATE"),
        F.concat(F.lit(" "), F.lower(F.col("r_name"))).alias("STATE"),
        F.concat(F.lit(" "), F.col("c_mktsegment")).alias("SPECIALTY"),
    ))


def overlapping_exclusions(exclusions: DataFrame) -> DataFrame:
    """Each exclusion with three more of the same provider: one that overlaps it, one that
    lies after it or within it, and one that ends as it begins."""
    more = [("1128b4", "19980101", "19990701"), ("1128b5", "20010301", "20010901"), ("1128a3", "19960601", "19960601")]
    out = exclusions
    for kind, begin, end in more:
        out = out.unionByName(exclusions.withColumns({"EXCLTYPE": F.lit(kind), "EXCLDATE": F.lit(begin), "REINDATE": F.lit(end)}))
    return out


def tables_from_star(spark: SparkSession, sf_dir: str) -> ClaimsTables:
    return ClaimsTables(
        spending=spending_from_star(spark, sf_dir),
        registry=registry_view(registry_from_star(spark, sf_dir)),
        exclusions=normalize_exclusions(exclusions_raw_from_star(spark, sf_dir)),
    )
