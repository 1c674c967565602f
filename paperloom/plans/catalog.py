"""All registered queries of the curation operators and their SQL counterparts."""

from paperloom.plans import extraction, pairs, sources, status, texts  # noqa: F401  they register
from paperloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
