"""claimlens: provider-billing anomaly signals as Spark DataFrame plans.

Layout
------
sources/    table loaders (claims, registry, exclusions), CSV ingest, sinks
functions/  reusable Column expressions and skew-safe building blocks
operators/  the six signals and their detail look-ups, shared rollups
plans/      session setup, the all-signals flag table and the report job
streaming/  intentionally empty (the studied system is batch only)
"""

from claimlens.config import SignalConfig, DEFAULT_CONFIG  # noqa: F401

__version__ = "0.1.0"
