"""The queries of the core and, where SQL can say the same, their SQL for an independent engine."""

from reelbase import further, queries
from reelbase.operators import multivalue

QUERIES = {**queries.QUERIES, **further.QUERIES, **multivalue.QUERIES}
ORACLE: dict[str, str] = {**queries.ORACLE, **further.ORACLE}
