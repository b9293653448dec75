"""All queries of the library by name, and SQL for those that SQL can express."""

from __future__ import annotations

from citelens.plans import base, further
from citelens.plans.base import Query


def queries() -> dict[str, Query]:
    return base.queries() | further.queries()


def oracle_sql() -> dict[str, str]:
    return base.oracle_sql() | further.oracle_sql()
