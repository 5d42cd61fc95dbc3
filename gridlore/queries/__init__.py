"""All registered queries."""

from gridlore.queries import business, core, fraud_risk, insight, modelling, quality, sales  # noqa: F401
from gridlore.queries import domains  # noqa: F401  (uses the others' SQL)
from gridlore.queries.registry import ORACLE, QUERIES  # noqa: F401
