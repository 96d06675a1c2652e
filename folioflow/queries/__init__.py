"""All queries of the library's own operators, each with the SQL it is held against where SQL can express it."""

from folioflow.queries import audit, layout, routing, text

QUERIES = text.QUERIES | layout.QUERIES | audit.QUERIES | routing.QUERIES
ORACLE = text.ORACLE | layout.ORACLE | audit.ORACLE | routing.ORACLE
