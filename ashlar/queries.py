"""All queries of the library outside of `llm`, by name, with their SQL."""

from __future__ import annotations

from ashlar.plans import evidence, hosts, matching, more, parts, pricing, reading, scoring, screening, serving, sources, streams, variants  # noqa: F401  they register themselves
from ashlar.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "qualifying_parts"
