"""Named queries over the driver tables, each with an SQL statement of the
same result where SQL can state it."""

from weftspan.catalog.registry import all_queries, all_sql  # noqa: F401
