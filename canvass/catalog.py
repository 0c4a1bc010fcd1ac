"""All registered queries of the survey engine and their SQL."""

from __future__ import annotations

from canvass.queries import metrics, relations, sampling, surveys, texts
from canvass.queries.base import Query

PARTS = (metrics.R, relations.R, sampling.R, surveys.R, texts.R)


def queries() -> dict[str, Query]:
    return {k: q for part in PARTS for k, q in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.sql.items()}
