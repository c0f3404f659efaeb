"""All registered queries of the financial operators, and the SQL they are checked against."""

from __future__ import annotations

from pitlake.plans import evidence, extraction, filings, governance, intake, reports, review, selection, texts, valuation  # noqa: F401  (they register their queries)
from pitlake.plans.queries import ORACLES, QUERIES

FLAGSHIP = "metrics_quarterly"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
