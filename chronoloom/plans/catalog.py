"""Registry of the timeline queries and the SQL they are held against."""

from chronoloom.plans import cutting, details, editing, jobs, metrics, projects, rules, shorts, speech, style

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (speech, editing, cutting, metrics, jobs, details, rules, projects, shorts, style):
    QUERIES |= module.Q
    ORACLE_SQL |= module.SQL
