"""Table sources (claims, registry, exclusions), CSV ingest and sinks."""

from claimlens.sources.tables import ClaimsTables, load_domain_tables, load_star_tables  # noqa: F401
