"""All core queries and their SQL."""

from tracewell.plans import relational, scalar

QUERIES: dict = {**scalar.QUERIES, **relational.QUERIES}
SQL: dict = {**scalar.SQL, **relational.SQL}
